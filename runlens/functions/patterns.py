"""The patterns and words that decide what a line is.

All are in Java's dialect; ``(?U)`` makes classes and word bounds Unicode.
"""

# Terminal escapes: OSC, CSI, charset, keypad. OSC bodies may span lines.
ESCAPES = r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b\[[0-?]*[ -/]*[@-~]|\x1b[()][0-9A-Za-z]|\x1b[=>]"

# Progress bars: a run of bar glyphs, and an amount.
BAR = r"(?U)[█▓▒░]{2,}|[#=]{4,}>?|\[[=\-#>\s]{4,}\]"
AMOUNT = r"(?U)\d{1,3}(?:\.\d+)?\s*%|\d+\s*/\s*\d+"
BAR_TEMPLATE_DROPS = "0123456789=#>-. \t%█▓▒░"

# Lines that signal failure.
ERROR_WORDS = (
    r"(?iU)\b(?:errors?|fail(?:s|ed|ure|ures)?|exception|panic(?:ked)?|fatal|traceback|assert(?:ion)?"
    r"|segmentation fault|core dumped|permission denied|no such file or directory|not found|cannot|undefined reference)\b"
)
ERROR_MARKS = r"(?U)\bERR!|\bKilled\b|^E\s{2,}|[A-Za-z_][A-Za-z0-9_]*(?:Error|Exception)\b"

# Log levels after an optional time.
LEVEL = r"(?U)^\s*(?:\[?\d{4}-\d{2}-\d{2}[T ][\d:.,+Z\-]+\]?\s+)?\[?\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b\]?"
NOISE = ("TRACE", "DEBUG", "INFO")
LEVEL_NAMES = {"WARNING": "WARN", "CRITICAL": "FATAL"}

# Numeric slots: long hex ids first, then digits.
SLOT = r"(?U)\b[0-9a-fA-F]{8,}\b|\d+"

# Compiler diagnostics.
GCC = r"(?U)^(\S+?:\d+(?::\d+)?):?\s+(error|warning|note)\b[:\[]?\s*(.*)$"
RUSTC = r"(?U)^(error|warning)(?:\[([A-Z]+\d+)\])?: (.+)$"

# Within a compiler block: its place, asides, the label under a caret, and drawing.
ARROW = r"(?Ud)^\s*-->\s+(\S+:\d+(?::\d+)?)\s*$"
ASIDE = r"(?Ud)^\s*(?:= )?(help|note): (.+)$"
LABEL = r"(?Ud)^\s*\d*\s*\|[\s|\-]*\^+\s+(\S.*)$"
SCAFFOLD = r"(?U)^\s*(?:\d*\s*[|+\-~]|\.\.\.|-->|:::)"

# Words and marks of the token ceiling's own, broader idea of an error line.
BUDGET_WORDS = ("error", "fail", "panic", "exception", "traceback", "fatal", "segfault", "segmentation fault", "killed", "denied", "abort")
BUDGET_MARKS = ("E   ", "npm ERR!")
