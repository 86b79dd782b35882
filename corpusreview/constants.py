"""Values the results depend on.

Everything in this module is a FIXED VALUE: extension and word lists, thresholds, patterns and message formats that a
consumer of the tables compares against.  Change one and the published results change.
"""

# ---- file selection -------------------------------------------------------------------------------------------------
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "typescript",
    ".java": "java",
}
DEFAULT_LANGUAGES = ("python", "javascript", "typescript", "java")
VENDORED_PARTS = ("node_modules", "__pycache__", "venv", ".venv", "dist", "build")
MAX_FILE_SIZE_KB = 50
SKIP_REASON = "File too large or unreadable"
NO_FILES_MESSAGE = "No supported source files found in the repository."

# ---- text ------------------------------------------------------------------------------------------------------------
# Line separators and white space as Python's str.splitlines / str.strip see them.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
UNUSUAL_LINE_BREAK = "[\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
MAX_PROMPT_LINES = 200
README_TREE_FILES = 50
README_SAMPLES = 5
README_SAMPLE_CHARS = 500
DOC_SAMPLE_CHARS = 1000
MATCH_CHARS = 50
SUMMARY_CHARS = 80

# ---- smells ----------------------------------------------------------------------------------------------------------
LONG_FILE_LINES = 300
LONG_FUNCTION_LINES = 50
MAX_NESTING = 4
LONG_LINE_CHARS = 120
MAGIC_NUMBER = r"(?U)(?=\d)(?<!=\s)(?<!\w)\b(?!0\b|1\b|2\b)(\d{2,})\b"
VAR_DECLARATION = r"(?U)\bvar\s+[a-zA-Z0-9_$]+"
CONSOLE_LOG = "console.log"
TODO_MARKERS = ("TODO", "FIXME")
DOC_MARKERS = ('"""', "'''", "/**", "/*")
SMELL_TEXT = {
    "long_file": "File is %d lines long (>300). Consider splitting.",
    "magic_number": "Magic number %s — consider using a named constant.",
    "long_function": "Function '%s' is %d lines long (>50). Consider breaking it up.",
    "missing_docstring": "Function '%s' has no docstring.",
    "deep_nesting": "Function '%s' has nesting depth %d (>4). Refactor to reduce nesting.",
    "console_log": "Uses 'console.log'. Consider using a proper logging library or deleting it.",
    "var_usage": "Uses 'var' for variable declaration. Use 'let' or 'const' instead.",
}
LONG_LINE_TEXT = "Line %d exceeds 120 characters (%d chars)."
TODO_TEXT = "Line %d contains developer comment placeholder (TODO/FIXME)."
NO_QUALITY_ISSUE = "No simple code smells detected."

# ---- security rules, in reporting order ------------------------------------------------------------------------------
# (?i) with (?u) folds case over all of Unicode, (?U) makes \w \d \s \b Unicode-aware, (?d) lets "." stop at \n only.
# A leading look-ahead at the first letters changes no match: it only lets most positions of a text fail at once.
SECURITY_RULES = (
    (
        "hardcoded_secret",
        r"(?iuUd)(?=[apst])(password|secret|passwd|api_key|apikey|private_key|token)\s*=\s*['\"][a-zA-Z0-9_\-\+]{10,}['\"]",
    ),
    ("unsafe_execution", r"(?Ud)(?=[esc])\b(eval|exec|subprocess\.Popen\(.*?shell\s*=\s*True|child_process\.exec)\b"),
    ("sql_injection", r"(?iuUd)(?=[siud])(SELECT|INSERT|UPDATE|DELETE).*?\+.*?\b"),
    ("insecure_deserialization", r"(?Ud)(?=[py])\b(pickle\.loads|yaml\.load)\b"),
)
# The same matches in linear time: a start without a later "+" takes the rest of its line in one step, as no later start of
# the line can match either.  Group 1 is empty for such a stretch, which is no match.
LINEAR_RULES = {"sql_injection": r"(?iuUd)(?=[siud])(?:SELECT|INSERT|UPDATE|DELETE)(?:([^+\n]*+\+.*?\b)|[^\n]*+)"}
# The same for texts that are marked: a match is group 1, a stretch without one group 2.
LINEAR_MARKS = {
    "sql_injection": r"(?iuUd)(?=[siud])(?:((?:SELECT|INSERT|UPDATE|DELETE)[^+\n]*+\+.*?\b)|((?:SELECT|INSERT|UPDATE|DELETE)[^\n]*+))"
}
# Matches of these rules hold one of these texts, letter by letter.
CALL_HEAD = "subprocess.Popen("
PLAIN_HEADS = {
    "hardcoded_secret": ("=",),
    "unsafe_execution": ("eval", "exec", CALL_HEAD),
    "sql_injection": ("+",),
    "insecure_deserialization": ("pickle.loads", "yaml.load"),
}
# The calls of unsafe_execution, and its plain words.  A call without the closing part takes the rest of its line (group 4), as
# no later call of the line can have one either.  Groups 2 and 3 hold the line breaks inside a match.
OPEN_CALL = r"(?Ud)\bsubprocess\.Popen\("
UNSAFE_CALL = r"(?Ud)\b(?:(subprocess\.Popen\(.*?shell(\s*)=(\s*)True\b)|(subprocess\.Popen\([^\n]*+))"
UNSAFE_WORD = r"(?Ud)(?=[ec])\b(?:eval|exec|child_process\.exec)\b"
# every match of any rule holds one of these
SECURITY_HEADS = (
    r"(?iuUd)(?=[apsteciudy])(?:password|secret|passwd|api_?key|private_key|token|eval|exec|subprocess\.Popen|select|insert|update"
    r"|delete|pickle\.loads|yaml\.load)"
)
VULNERABILITY_TEXT = "Potential %s vulnerability detected."

# ---- refactoring and docstring tools ---------------------------------------------------------------------------------
REFACTOR_LONG = "Break the block into smaller functions to improve readability."
REFACTOR_COMPLEX = "Simplify control flow (e.g. reduce nested if/for/while blocks)."
REFACTOR_DEEP = "Deep indentation levels detected. Extract nested logic into separate helper methods."
REFACTOR_NONE = "Structure is clean. Standard formatting applied."
REFACTOR_LINES = 50
REFACTOR_COMPLEXITY = 5
REFACTOR_INDENT = 16
ELEMENT_NAME = r"(?U)\b(def|class|function)\s+([a-zA-Z0-9_$]+)"
ELEMENT_PARAMS = r"(?d)\((.*?)\)"
DOCSTRING_CLASS = '"""Class %s.\n\nDetailed class description goes here.\n"""'
DOCSTRING_MODULE = '"""Module %s.\n\nModule level documentation goes here.\n"""'
DOCSTRING_FUNCTION = (
    '"""Function %s.\n\nDetailed function description goes here.%s\n\n    Returns:\n        Description of return value.\n    """'
)
DOCSTRING_ARGS = "\n    Args:\n"
DOCSTRING_ARG = "        %s: Description of %s."
TOOLS = ("analyze_code_quality", "detect_security_vulnerability", "generate_docstring", "suggest_refactoring")
UNKNOWN_TOOL = "Unknown tool: %s"

# ---- JavaScript / TypeScript structure -------------------------------------------------------------------------------
# Names, gaps and the third alternative are written with possessive quantifiers: same matches, no back-tracking into a name or
# on an unclosed "(".
JS_FUNCTION = (
    r"(?Ud)(?=[a-zA-Z0-9_$])\b(?:(?:function\s++([a-zA-Z0-9_$]++)\s*+\()"
    r"|(?:const|let|var)\s++([a-zA-Z0-9_$]++)\s*+=\s*+(?:async\s*+)?\(.*?\)\s*+=>"
    r"|([a-zA-Z0-9_$]++)\s*+\((?:[^()]++|\([^()]*+\))*+\)\s*+\{)"
)
# An arrow function's start: group 2 is the rest up to the arrow or, where the line has none, group 3 the rest of the line.  No
# start in group 3 can have an arrow, so its keyword is put out of the pattern's sight.
JS_ARROW = r"(?Ud)(?=[clv])(\b(?:const|let|var)\s+[a-zA-Z0-9_$]+\s*=\s*(?:async\s*)?\()(?:(.*?\)\s*=>)|([^\n]*+))"
JS_KEYWORD = r"(?U)\b(?:const|let|var)(?=\s+[a-zA-Z0-9_$]+\s*=\s*(?:async\s*)?\()"
JS_NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch")
JS_CLASS = r"(?U)\bclass\s+([a-zA-Z0-9_$]+)"
JS_IMPORT = r"(?Ud)(?=[ir])(?:\bimport\s+.*?\s+from\b|\brequire\s*\()"
JS_BRANCH = r"(?U)(?=[ifwcs&|?])(?:\b(if|for|while|catch|switch|case)\b|&&|\|\||\?)"

# ---- reviews and reports ---------------------------------------------------------------------------------------------
SEVERITIES = ("critical", "warning", "info")
SEVERITY_LABEL = {"critical": "Critical", "warning": "Warning", "info": "Info", "suggestion": "Suggestion"}
SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2, "suggestion": 3}
UNKNOWN_SEVERITY_ORDER = 99
CATEGORIES = (
    "security", "performance", "best-practice", "code-quality", "error-handling", "documentation", "maintainability",
    "accessibility", "testing", "style", "bug", "other",
)
FALLBACK_SCORE = 50.0
NO_REVIEWS_SCORE = 100.0
WEIGHT_CRITICAL, WEIGHT_ISSUES, WEIGHT_CLEAN = 1.5, 1.0, 0.8
QUALITY_BANDS = ((90, "excellent"), (75, "good"), (50, "needs improvement"))
QUALITY_ELSE = "poor"
DIAL_BANDS = ((80, "excellent"), (60, "good"), (40, "fair"))
DIAL_ELSE = "poor"
CHIP_BANDS = ((80, "good"), (50, "warn"))
CHIP_ELSE = "bad"
SCORE_BANDS = (
    ("Excellent (90-100)", 90, 100),
    ("Good (75-89)", 75, 89),
    ("Fair (50-74)", 50, 74),
    ("Poor (0-49)", 0, 49),
)
TOP_CATEGORIES = 8
TOP_FILES = 5
RECENT_ITEMS = 5
UNKNOWN_FILE = "Unknown file"
REPORT_TEXT = (
    "Repository analysis complete. Reviewed %d file(s) with an overall quality score of %s/100 (%s). "
    "Found %d critical issue(s), %d warning(s), and %d informational note(s)."
)
FALLBACK_TEXT = "Analyzed %d files."

# ---- event log and progress ------------------------------------------------------------------------------------------
EVENT_KINDS = (
    "clone_start", "clone_complete", "file_start", "file_skip", "file_complete", "analysis_complete", "error",
)
END_OF_LOG = "[DONE]"
DEFAULT_EVENT = "message"
PHASE_CLONING = "Cloning repository..."
PHASE_FOUND = "Found %d source files. Starting analysis..."
PHASE_FILE = "Analyzing file %d of %d..."
PHASE_SKIP = "Skipped %s: %s"
