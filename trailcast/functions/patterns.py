"""Regular expressions and word lists that decide the results.

They are plain data. Spark prefixes them with ``(?U)`` so that classes such as
``\\w`` and ``\\s`` are Unicode-aware; an ASCII engine can run them as they are.
"""

# Command families, highest priority first.
SUBMIT = [
    r"COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT",
    r"\bsubmit\b",
    r"\bend_task\b",
]
TEST = [
    r"\bpython\s+-m\s+pytest\b",
    r"\bpytest\b",
    r"\bpy\.test\b",
    r"\bunittest\b",
    r"\btox\b",
    r"\bnox\b",
    r"\bmake\s+test\b",
    r"\bpython3?\s+(?:[\w./-]*/)?(?:reproduce|repro|reproduce_bug|run_tests?|verify\w*|check_\w*|mre|minimal_?repro)[\w./-]*\.py\b",
    r"\bpython3?\s+(?:[\w./-]*/)?test_[\w./-]*\.py\b",
]
EDIT = [
    r"\bapply_patch\b",
    r"\bedit\b\s+\d+:\d+",
    r"\bcreate\s+[\w./-]+\.\w+",
    r"\bstr_replace\b",
    r"\binsert\b\s+\d+",
    r"\bpyupgrade\b",
    r"cat\s+<<\s*['\"]?\w+['\"]?\s*>\s*[\w./-]+",
    r">\s*[\w./-]+\.(?:py|js|ts|txt|cfg|toml|yaml|yml|json|md|rst)\b",
    r"\bsed\s+-i\b",
    r"\bpython\b[^\n]*open\([^)]*['\"][wa]",
    r"\btee\b",
]
INSTALL = [
    r"\bpip\s+install\b",
    r"\bpip3\s+install\b",
    r"\bpython\s+-m\s+pip\s+install\b",
    r"\bconda\s+install\b",
    r"\bapt-get\b",
    r"\bapt\s+install\b",
    r"\bpoetry\s+(?:add|install)\b",
    r"\bsetup\.py\s+install\b",
]
GIT = [
    r"\bgit\s+diff\b",
    r"\bgit\s+status\b",
    r"\bgit\s+checkout\b",
    r"\bgit\s+reset\b",
    r"\bgit\s+stash\b",
    r"\bgit\s+log\b",
    r"\bgit\s+add\b",
    r"\bgit\s+commit\b",
    r"\bgit\s+restore\b",
]
SEARCH = [
    r"\brg\b",
    r"\bgrep\b",
    r"\bfind\b",
    r"\back\b",
    r"\bag\b",
    r"\bgit\s+grep\b",
    r"\bsearch_dir\b",
    r"\bsearch_file\b",
    r"\bfind_file\b",
]
READ = [
    r"\bcat\b",
    r"\bsed\s+-n\b",
    r"\bnl\s+-ba\b",
    r"\bhead\b",
    r"\btail\b",
    r"\bless\b",
    r"\bmore\b",
    r"\bopen\b\s+[\w./-]+",
    r"\bgoto\b\s+\d+",
    r"\bscroll_(?:up|down)\b",
]
ENVIRONMENT = [
    r"\bcd\b",
    r"\bls\b",
    r"\bpwd\b",
    r"\bexport\b",
    r"\bsource\b",
    r"\bconda\s+activate\b",
    r"\bmkdir\b",
    r"\bwhich\b",
    r"\becho\b",
    r"\benv\b",
    r"\brm\b",
    r"\bmv\b",
    r"\bcp\b",
    r"\btouch\b",
    r"\bchmod\b",
]
FAMILIES = {
    "submit": "|".join(SUBMIT),
    "test": "|".join(TEST),
    "edit": "|".join(EDIT),
    "install": "|".join(INSTALL),
    "git": "|".join(GIT),
    "search": "|".join(SEARCH),
    "read": "|".join(READ),
    "environment": "|".join(ENVIRONMENT),
}
FLAGGED = ["test", "search", "read", "edit", "git", "install", "submit"]
ACTION_TYPES = ["read", "search", "edit", "test", "git", "install", "submit", "environment", "other"]

# File paths, test results and errors in step text.
FILE_PATH = (
    r"((?:[\w.-]+/)*[\w.-]+\.(?:py|pyi|js|ts|tsx|jsx|java|go|rs|cpp|cc|c|h|hpp|rb|php|sh"
    r"|yaml|yml|toml|cfg|ini|json|md|rst|txt))"
)
# The same extensions, longest alternative first and closed by a boundary.
FILE_PATH_LONGEST = (
    r"((?:[\w.-]+/)*[\w.-]+\.(?:java|json|yaml|toml|pyi|tsx|jsx|cpp|hpp|php|yml|cfg|ini|rst|txt"
    r"|py|js|ts|go|rs|cc|rb|sh|md|c|h)\b)"
)
N_PASSED = r"(\d+)\s+passed"
N_FAILED = r"(\d+)\s+failed"
N_ERRORS = r"(\d+)\s+errors?"
FAILED_LINE = r"(?m)^(?:FAILED|ERROR)\b"
PASSED_LINE = r"(?m)^PASSED\b"
TRACEBACK = r"(?m)Traceback \(most recent call last\)|^Traceback\b"
EXCEPTION = r"\b[A-Za-z_]\w*(?:Error|Exception)\b"
ASSERTION = r"\bAssertionError\b"

# Error categories counted in observations.
ERROR_CATEGORIES = {
    "cmd_not_found": r"(?i)command not found|not found:|: not found",
    "no_such_file": r"(?i)No such file or directory|cannot find|does not exist",
    "no_matches": r"(?i)No matches found|no matches for|0 matches|not found in",
    "permission": r"(?i)Permission denied|Operation not permitted",
    "syntax": r"(?i)\bSyntaxError\b|\bIndentationError\b|invalid syntax",
    "import_err": r"(?i)\bImportError\b|\bModuleNotFoundError\b|cannot import name",
    "name_err": r"(?i)\bNameError\b|is not defined",
    "type_err": r"\bTypeError\b",
    "attr_err": r"\bAttributeError\b",
    "key_index_err": r"\bKeyError\b|\bIndexError\b",
    "value_err": r"\bValueError\b",
    "assertion": r"\bAssertionError\b|assert ",
    "traceback": r"Traceback \(most recent call last\)",
    "usage_err": r"(?i)\busage:|unrecognized arguments|invalid choice|unexpected argument",
    "timeout": r"(?i)timed out|timeout|TimeoutError",
    "test_fail_tok": r"\bFAILED\b|\bFAIL\b|\bERROR\b",
}

# Message structure.
FENCED_BLOCK = r"(?s)```(?:bash|sh|python|py)?\s*\n(.*?)```"
CODE_BLOCK = r"(?s)```(?:python|py)?\s*\n(.*?)```"
THOUGHT_LABEL = r"(?is)\b(?:thought|discussion)\s*:?\s*(.*?)(?:\baction\s*:|\z)"
ACTION_LABEL = r"(?is)\baction\s*:?\s*(.*)\z"
ASSISTANT_ROLES = ["assistant", "ai"]
TRUTHY_WORDS = ["true", "1", "yes", "resolved", "success", "pass", "passed"]

# Characters that count as white space and as line ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# First words of commands.
INVESTIGATE_VERBS = [
    "cat", "grep", "ls", "head", "tail", "find", "find_file", "nl", "less", "wc", "diff",
]
ACT_VERBS = ["sed", "python", "python3", "echo", "mv", "cp", "touch", "printf", "awk"]
PRODUCTIVE_VERBS = [
    "cat", "ls", "grep", "head", "tail", "open", "python", "python3",
    "sed", "find", "find_file", "diff", "wc", "less", "nl",
]
CHATTER_STARTS = ["here", "i ", "the ", "to "]

# Names no feature column may contain.
OUTCOME_NAMES = [
    "target", "y_fail", "eval_logs", "generated_patch", "exit_status",
    "resolved", "passed_final", "fail_to_pass", "pass_to_pass", "final_patch",
]
