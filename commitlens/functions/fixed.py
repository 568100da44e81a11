"""Fixed values that must equal the source pipeline's for equal results.

Everything in this module is data, stated plainly and in its original order.
Nothing here is logic; the operators that use these values live elsewhere.
"""

# --- FIXED VALUES: heuristic commit filter -----------------------------------

# Titles that carry no information when the commit has no description
# (matched case-insensitively; 46 entries, 45 distinct after lower-casing).
USELESS_TITLES = [
    "Update README.md", "refactoring", "add new screenshots", "remove old screenshots",
    "update icon", "initial commit", "Reformat", "Fix compilation", "formatting", "added",
    "update f-droid metadata", "add todos", "remove dead code", "Dutch",
    "adding a new string for Go to date",
    "Move source files to a more standard location", "Refactor",
    "replace last occurrences of the old package id",
    "update links", "update dependencies", "Updated changelog.", "Update changelog.",
    "Updated the changelog.",
    "updating commons", "Update imports", "Update libs", "Update genius scan sdk",
    "refactor: Update files Header",
    "Update", "Merge master", "Cleanup.", "...", "new version", "init", "Release", "Bug fixes",
    "Year++", "fix errors", "Bump version", "no message", "Fixes", "Update README", "Refactoring",
    "Updates", "Updated texts", "Initial import",
]

# Title patterns (searched anywhere in the title), applied to rows without a
# description, in this order.
TITLE_PATTERNS = [
    ("version_number", r"version\s+\d+(\.\d+)*"),
    ("merge_pull_request", r"Merge pull request #\d+ from \w+/\w+"),
    ("merge_branch", r"Merge branch '\w+'"),
    ("version_number_v", r"v\d+(\.\d+)*"),
    ("version_number_pure", r"\d+(\.\d+)*"),
    ("release_version_number", r"Release \d+(\.\d+)*"),
    ("update_kotlin", r"Update Kotlin to version \d+(\.\d+)*"),
    ("added_files", r"added [\w.]+ files"),
    ("remove_files", r"remove [\w.]+ files"),
]

# --- FIXED VALUES: model answer formats --------------------------------------

FILTER_IS_PERF_HEADER = "###Is_Perf_Optimization"
FILTER_TYPE_HEADER = "###Performance_Issue_Type"
CLASS_TYPE_HEADER = "###Optimized_Performance_Issue_Type\n    "
CLASS_CAUSE_HEADER = "\n\n###Root_Causes"
BAD_FORMAT = "Not Match Format"
NA_MARKER = "N/A"
EMPTY_DESCRIPTION = "EMPTY"
TEMPLATE_SLOT = "#{}#"

# --- FIXED VALUES: issue-type taxonomy (raw label -> category) ----------------

TAXONOMY = [
    ("Responsiveness", "Responsiveness"),
    ("Efficiency", "Responsiveness"),
    ("Concurrency", "Responsiveness"),
    ("Concurrency Issues", "Responsiveness"),
    ("Memory Consumption", "Memory Consumption"),
    ("Storage Consumption", "Storage Consumption"),
    ("Data Usage", "Storage Consumption"),
    ("Disk Space Consumption", "Storage Consumption"),
    ("Energy Consumption", "Energy Consumption"),
    ("Build Time", "Compilation Time"),
    ("Build Speed", "Compilation Time"),
    ("Compilation Time", "Compilation Time"),
    ("Compilation Speed", "Compilation Time"),
    ("Compile Time", "Compilation Time"),
    ("Build Performance", "Compilation Time"),
    ("Testing Time", "Compilation Time"),
    ("CPU Consumption", "CPU Usage"),
    ("CPU Usage", "CPU Usage"),
    ("CPU Utilization", "CPU Usage"),
    ("CPU Load", "CPU Usage"),
    ("CPU Time", "CPU Usage"),
    ("Network Performance", "Network Performance"),
    ("Network Consumption", "Network Performance"),
    ("Bandwidth Consumption", "Network Performance"),
    ("Network Traffic", "Network Performance"),
    ("Graphics Rendering", "Graphics Rendering"),
    ("Scalability", "Scalability"),
]

# Raw labels that are known but deliberately dropped by the taxonomy.
TAXONOMY_IGNORED = [
    "Image Processing", "Security", "CPU Ranking", "Code Optimization",
    "Data Transfer", "CPU Cycles", "IO Performance", "Compatibility",
]

# --- FIXED VALUES: sample-size formula ----------------------------------------

Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
SAMPLE_DEFAULTS = {"confidence_level": 0.95, "margin_of_error": 0.05, "proportion": 0.5}

# --- FIXED VALUES: pipeline thresholds ----------------------------------------

MAX_FILES_PER_COMMIT = 5
MAX_COMMITS_PER_PROJECT = 5000
SCORING_BATCH = 500

# --- FIXED VALUES: release asset preference -----------------------------------

PREFERRED_APKS = ["app-universal-release.apk", "mobile.apk"]
EXCLUDED_ARCHIVE = "html.zip"

# --- FIXED VALUES: performance issue terms named in the filter rubric ---------

RUBRIC_ISSUE_TERMS = [
    "energy leak", "memory bloat", "slow rendering", "frozen frames",
    "application not responding", "ANR", "UI freeze", "UI lag", "resource leak",
    "resource utilization bug", "energy bug", "resource inefficiency",
    "energy black hole", "sluggish performance", "wasted energy",
    "service usage inefficiency",
]

# --- FIXED VALUES: prompt layouts -------------------------------------------
# Slot template of the commit-message filter input.
FILTER_INPUT_TEMPLATE = "###Commit_Title\n#{}#\n\n\n###Commit_Description\n#{}#"
# Slot template of the diff-analysis input.
DIFF_INPUT_TEMPLATE = (
    "###Commit_Message\n#{}#\n\n\n###Code_Diff\n#{}#\n\n\n"
    "Please answer the following questions one-by-one:\n"
    "1. What was the performance issue before the commit?\n"
    "2. In which file and lines did the performance issue occur before the modification?\n"
    "3. What were the root causes of the performance issue?\n"
    "4. How was the performance issue resolved after the modification?\n"
)
# One rendered changed file: number, name and the patch indented by two tabs.
DIFF_FILE_FORMAT = "file {n}{{\n\tfile name: {name}\n\tpatch:\n{patch}\n}}\n"

# Files of these types are not compared by the verification step.
UNCHECKED_SUFFIXES = (".apk", ".so")

# Anchor text of the link to the next listing page, and the test id of the
# next-page button of a commit list.
NEXT_LISTING_TEXT = "Older Posts"
NEXT_BUTTON_ID = "pagination-next-button"

# HTML character references that occur in the crawled pages; the ampersand comes last.
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
                 ("&nbsp;", "\u00a0"), ("&#160;", "\u00a0"), ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&middot;", "\u00b7"),
                 ("&hellip;", "\u2026"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&laquo;", "\u00ab"), ("&raquo;", "\u00bb"),
                 ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&#38;", "&"), ("&amp;", "&")]
