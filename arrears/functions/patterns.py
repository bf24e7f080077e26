"""Pattern sets and classes of debt, as parameters for the text functions."""

# Markers and phrases of the main scan, in order of priority.
EXPLICIT = ["TODO", "FIXME", "HACK", "XXX", "BUG", "ISSUE", "DEBT", "NOTE", "WARNING", "OPTIMIZE", "REVIEW", "REVISIT", "REFACTOR"]
IMPLICIT = [
    "workaround", "temporary", "hacky", "should be improved", "quick fix", "quick and dirty", "not ideal", "not optimal", "needs refactoring",
    "needs work", "needs cleanup", "could be better", "could be improved", "to be improved", "fix later", "refactor later", "clean up later",
    "technical debt", "tech debt", "code smell", "ugly", "messy", "dirty", "poor", "bad design", "magic number", "hardcoded", "hard-coded",
    "hard coded", "deprecated", "legacy", "obsolete", "performance issue", "slow", "inefficient", "memory leak", "resource leak",
    "race condition", "deadlock", "concurrency issue", "security issue", "vulnerability", "insecure", "not tested", "untested", "needs test",
    "missing test", "incomplete", "unfinished", "work in progress", "wip", "placeholder", "stub", "dummy", "copy-paste", "duplicate",
    "duplicated", "brittle", "fragile", "flaky", "assumption", "assumes", "expecting", "simplistic", "naive", "brute force", "overkill",
    "over-engineered", "complex", "type: ignore", "noqa", "pylint: disable", "eslint-disable", "suppress", "@SuppressWarnings",
    "noinspection", "NOSONAR", "checkstyle:off", "sonar:off",
]
ALL = EXPLICIT + IMPLICIT

# What the lowest detection level looks for, the levels, and languages by extension.
CORE = ["TODO", "FIXME"]
LEVELS = ("basic", "standard", "comprehensive")
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py", "pyw", "pyi", "pyc", "pyd", "pyo"],
    "java": ["java", "jsp", "jspf", "jspx"],
}
GENERIC = "generic"

# Regular expressions of the evaluation.
MARKERS_RE = ["TODO", "FIXME", "HACK", "XXX", "BUG", "KLUDGE", "TEMP", "DEPRECATED"]
EXPLICIT_RE = ["TODO", "FIXME", "HACK", "XXX", "BUG", "KLUDGE", "TRICKY", "WARNING", "NOTE", "TEMP", "TEMPORARY", "DEPRECATED"]
IMPLICIT_RE = [
    "workaround", "quick.?fix", "dirty", "ugly", "should.?be", "need.?to", "needs?.?refactor", "cleanup", "clean.?up", "optimize", "improve",
    "better.?way", "for.?now", "temporarily", "not.?ideal", "suboptimal", "should.?fix", "must.?fix", "broken", "incomplete", "missing",
    "placeholder", "stub", "dummy", "magic.?number", "hardcode[d]?", "hard.?code[d]?",
]

# Words of the replay.
REPLAY = ["TODO", "FIXME", "HACK", "XXX", "BUG", "ISSUE", "DEBT", "NOTE", "WARNING", "OPTIMIZE", "REVIEW", "REVISIT", "REFACTOR", "WORKAROUND", "TEMPORARY", "KLUDGE"]
REPLAY_PHRASES = ["needs refactoring", "should be improved", "quick fix", "temporary solution", "hacky implementation"]

# The classes, tried in this order; a class is met if the lower-cased text contains one of its words.
CLASSES = {
    "Test": [
        "unit test", "integration test", "needs test", "add test", "write test", "test coverage", "test case", "test suite", "test function",
        "lack of test", "insufficient test", "untested", "more test", "regression test", "automated test", "manual test", "test this", "mock",
        "stub", "testing framework",
    ],
    "Implementation": [
        "hack", "workaround", "temporary", "temporary solution", "quick fix", "optimize", "optimization", "slow", "efficient", "inefficient",
        "magic number", "duplicated", "duplication", "duplicate code", "copy paste", "ugly", "messy", "needs refactoring", "needs work",
        "could be better", "quick and dirty", "fix later", "refactor later", "not ideal", "not optimal", "suboptimal", "revisit", "rework",
        "rewrite", "simplify", "complex", "complicated", "simplistic", "naive", "brute force",
    ],
    "Architecture": [
        "architecture", "component coupling", "cohesion", "module dependency", "layer", "microservice", "monolith", "separation of concerns",
        "single responsibility", "service layer", "infrastructure", "scaling", "scalability", "throughput", "latency", "response time",
        "bottleneck", "distributed", "reliability", "availability", "resilience",
    ],
    "Design": [
        "bad design", "poor design", "could be designed better", "design debt", "refactor", "abstraction", "flexibility", "maintainability",
        "extensibility", "poorly designed", "clean up", "cleanup", "clean this up", "redesign", "better design", "code smell", "technical debt",
        "tech debt", "antipattern", "anti-pattern", "decoupling", "coupling", "encapsulation", "design pattern", "inheritance", "hardcoded",
        "hard-coded", "hard coded", "hard-coding",
    ],
    "Documentation": [
        "documentation", "docs", "document", "comment", "needs explanation", "explain", "clarify", "what this does", "why this works",
        "how this works", "javadoc", "jsdoc", "docstring", "readme", "wiki", "undocumented",
    ],
    "Defect": [
        "bug", "defect", "issue", "problem", "error", "incorrect", "wrong", "broken", "doesn't work", "not working", "fails", "failure",
        "exception", "crash", "corrupted", "corruption", "overflow", "underflow", "memory leak", "resource leak", "null pointer", "segfault",
        "infinite loop", "race condition", "deadlock", "concurrency issue", "out of bounds", "boundary check", "edge case", "corner case",
        "vulnerability", "security hole", "security issue",
    ],
    "Requirement": [
        "requirement", "specification", "spec", "required", "need to support", "feature", "enhancement", "user story", "use case",
        "product owner", "stakeholder", "business rule", "acceptance criteria", "product backlog", "roadmap", "milestone", "not implemented yet",
    ],
}
DEFAULT_CLASS = "Other"
EVAL_CLASSES = {
    "Design": ["architecture", "design", "pattern", "refactor", "restructure"],
    "Test": ["test", "spec", "coverage", "unit", "integration"],
    "Documentation": ["doc", "comment", "javadoc", "readme", "explain"],
    "Defect": ["bug", "error", "crash", "fail", "broken", "wrong"],
    "Requirement": ["feature", "implement", "add", "support", "incomplete"],
    "Implementation": ["hack", "workaround", "quick", "temp", "dirty"],
}
EVAL_DEFAULT_CLASS = "Implementation"

# Comment markers by extension: found anywhere, or at the start of the stripped line.
HASH, C_LIKE, PHP = (("#",), ('"""', "'''")), (("//", "/*"), ("*",)), (("//", "#", "/*"), ("*",))
COMMENT = {".py": HASH, ".rb": (("#",), ()), ".php": PHP} | dict.fromkeys((".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go"), C_LIKE)
COMMENT_DEFAULT = (("//", "#", "/*"), ())
REPLAY_COMMENT = {".py": ("#", '"""', "'''"), ".rb": ("#",), ".php": ("//", "#", "/*", "*")} | dict.fromkeys(
    (".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".go"), ("//", "/*", "*")
)
EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rb", ".php"]
SKIPPED_FOLDERS = ["node_modules", "__pycache__", "venv", "dist", "build", "out"]

# Resolution base times by class, and the pipeline's constants.
BASE_TIME = {"Architecture": 4.0, "Design": 3.0, "Implementation": 2.0, "Documentation": 1.0, "Test": 2.0, "Defect": 2.5}
BASE_TIME_DEFAULT = 1.5
TAU, MAX_HOPS = 0.7, 5
SIR_WEIGHTS = (0.4, 0.3, 0.3)
RANK_WEIGHTS = (0.4, 0.3, 0.15, 0.15)
WINDOW, LAMBDA = 50, 0.5
EDGE_RANGES = {"call": (0.5, 1.0, 0.75), "module": (0.5, 1.0, 0.75), "data": (0.3, 0.9, 0.6), "control": (0.3, 0.9, 0.6)}
