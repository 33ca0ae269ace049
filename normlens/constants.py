"""Fixed values that results depend on.

These must stay exactly as listed: label strings, default run
parameters, the norm-restriction pattern and the stopword sets used by
the word statistics.
"""

# ---- fixed values: label domain -------------------------------------------
POSITIVE = "violation"
NEGATIVE = "non_violation"
# confusion-matrix order: rows = true label, columns = predicted label
CONFUSION_ORDER = (NEGATIVE, POSITIVE)

# ---- fixed values: run parameters (defaults) ------------------------------
NUM_TESTS = 100
BATCH_SIZE = 10
SEED = 21
NUM_SHOTS = 3          # few-shot examples per class
MIN_COMMUNITY_COMMENTS = 106   # eligibility: strictly more comments than this
MAX_RETRIES = 6

# ---- fixed values: restrictive-norm pattern (case-insensitive substring) ---
RESTRICTIVE_PATTERN = "no|not"

# ---- fixed values: characters replaced in file-safe model names -----------
UNSAFE_NAME_CHARS = '<>:"/\\|?*'

# ---- fixed values: audit-log lines (one entry per logged batch) ----------
# success:       "Attempt 0: SUCCESS" then "Repairs: ['raw input']"
# wrong size:    "Attempt N: parsed but wrong size (<parsed> != <expected>) Attempted Repairs: <list>"
#                for N = 0 (list ['raw input']) and N = 1 (list [])
# decode error:  "Attempt N: JSON decode error: <message>" for N = 0 and 1
AUDIT_SUCCESS = "Attempt 0: SUCCESS\nRepairs: ['raw input']\n"
AUDIT_WRONG_SIZE = "Attempt {attempt}: parsed but wrong size ({parsed} != {expected}) Attempted Repairs: {repairs}\n"
AUDIT_DECODE_ERROR = "Attempt {attempt}: JSON decode error: {message}\n"
AUDIT_REPAIRS = ("['raw input']", "[]")
AUDIT_LINE_PATTERN = (r"Attempt (\d+): (SUCCESS|parsed but wrong size \((\d+) != (\d+)\)"
                      r"|JSON decode error|unexpected error)")

# ---- fixed values: stopwords ----------------------------------------------
STOPWORDS = frozenset({
    # English
    "the", "and", "to", "of", "a", "in", "is", "it", "that", "for", "on", "with", "as", "this", "was", "are", "be",
    # Spanish
    "el", "la", "los", "las", "y", "de", "un", "una", "en", "es", "que", "para", "con", "como", "este", "esta", "fue", "son", "ser",
    # German
    "der", "die", "das", "und", "zu", "von", "ein", "eine", "ist", "es", "dass", "für", "mit", "als", "dies", "diese", "war", "sind", "sein",
    # French
    "le", "les", "et", "à", "de", "un", "une", "dans", "est", "il", "que", "pour", "avec", "comme", "ce", "cette", "était", "sont", "être",
})

EXTRA_STOPWORDS = frozenset({
    # German
    "sich", "mir", "mich", "bei", "aus", "wo", "des",
    # Italian
    "che", "ti", "te", "tu", "da", "po",
    # Indonesian
    "yang",
    # Slavic
    "na", "za",
})

ALL_STOPWORDS = STOPWORDS | EXTRA_STOPWORDS
