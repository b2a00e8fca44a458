"""Text operators for generated advice: keys, prompts, language and script checks, Markdown.

All of them are built-in column expressions (regexes, maps, concatenation), so they run
inside whole-stage code generation over whole texts, and work unchanged on streams.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference's (stated as text, in natural order).
# Languages offered, their scripts, speech codes, and the code-point range of each script.
LANGUAGE_CHOICES = ["English", "Hindi (हिन्दी)", "Kannada (ಕನ್ನಡ)", "Telugu (తెలుగు)",
                    "Tamil (தமிழ்)", "Malayalam (മലയാളം)"]
LANGUAGE_SCRIPT = {"English": "Latin", "Hindi": "Devanagari", "Kannada": "Kannada",
                   "Telugu": "Telugu", "Tamil": "Tamil", "Malayalam": "Malayalam"}
SPEECH_CODE = {"English": "en", "Hindi": "hi", "Kannada": "kn", "Telugu": "te",
               "Tamil": "ta", "Malayalam": "ml"}
SCRIPT_RANGES = {"Latin": [(0x0041, 0x007A)], "Devanagari": [(0x0900, 0x097F)],
                 "Kannada": [(0x0C80, 0x0CFF)], "Telugu": [(0x0C00, 0x0C7F)],
                 "Tamil": [(0x0B80, 0x0BFF)], "Malayalam": [(0x0D00, 0x0D7F)]}
SCRIPT_MIN_COVERAGE = 0.6
# Prompt wordings. "{crop}" and "{profile}" are filled per row.
SECTION_HEADERS = ["### NPK & Timing", "### pH Management", "### Irrigation",
                   "### Crop-Specific Practices", "### Extra Tips"]
PROMPTS = {
    "batch": {
        "system": ("You are an agronomy assistant. Based on N,P,K, pH, temperature, humidity and rainfall, "
                   "suggest safe, actionable recommendations (5–7 bullets) to improve yield for the given crop."),
        "user_tail": ("- Recommend N-P-K rates & timing, pH correction if needed, irrigation tips, "
                      "and any crop-specific best practices."),
        "sections": None,
    },
    "app": {
        "system": "You are an agronomy assistant. Answer in clean markdown with section headers and short bullets.",
        "user_tail": "\nWrite 5–7 concise recommendations using these sections:\n",
        "sections": SECTION_HEADERS,
    },
    "multilingual": {
        "system": ("You are an agronomy assistant. Reply in clean Markdown with section headers "
                   "and short, safe bullets."),
        "user_tail": "\nWrite 5–7 precise recommendations using these sections:\n",
        "sections": SECTION_HEADERS,
    },
}
TRANSLATE_SYSTEM = ("You are a precise translator. Translate the user's Markdown content exactly into the "
                    "requested language. Preserve headings, lists, numbers, units, and formatting. "
                    "Do NOT include any explanation or English.")
TRANSLATE_RETRY_PREFIX = "IMPORTANT: Do not include any English. Translate strictly.\n\n"
# Profile line: label=value pairs in this order; the crop defaults name the model inputs.
FACT_LINE_PATTERN = "N=%s P=%s K=%s, pH=%s, Temp=%s°C, Humidity=%s%%, Rainfall=%s mm"
FACT_LINE_COLUMNS = ["Nitrogen", "Phosphorus", "Potassium", "pH_Value", "Temperature", "Humidity", "Rainfall"]
# Characters Python's str.isspace() accepts (what "\s" and strip() mean in the reference).
PY_WHITESPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                 (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# ---------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _s(c) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def whitespace_class(dialect: str = "java") -> str:
    """Character class for PY_WHITESPACE in Java (Spark) or RE2 (DuckDB) syntax."""
    def one(cp):
        return f"\\x{{{cp:04X}}}"
    parts = []
    for item in PY_WHITESPACE:
        if isinstance(item, tuple):
            parts.append(f"{one(item[0])}-{one(item[1])}")
        else:
            parts.append(one(item))
    return "[" + "".join(parts) + "]"


def script_class(script: str, dialect: str = "java") -> str:
    rngs = SCRIPT_RANGES[script]
    body = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in rngs)
    return f"[{body}]"


# N5 ------------------------------------------------------------------------------------
def normalize_key(c) -> Column:
    """Lower-case, then drop everything but [a-z0-9] (lookup key for names and file stems)."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


# N10 -----------------------------------------------------------------------------------
def number_text(c, decimals: int | None = None) -> Column:
    """Render a number: fixed decimals, or the default double-to-text form."""
    if decimals is None:
        return _c(c).cast("double").cast("string")
    return F.format_string(f"%.{decimals}f", _c(c).cast("double"))


def fact_line(columns=None, pattern: str = FACT_LINE_PATTERN, decimals: int | None = None) -> Column:
    """One-line profile of a row, e.g. ``N=90.0 P=42.0 K=43.0, pH=6.5, ...``."""
    cols = columns or FACT_LINE_COLUMNS
    return F.format_string(pattern, *[number_text(c, decimals) for c in cols])


def generic_fact_line(columns, decimals: int | None = 2) -> Column:
    """``name=value`` pairs separated by spaces, for any feature list."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), number_text(c, decimals)) for c in columns])


# N11 -----------------------------------------------------------------------------------
def recommendation_prompt(crop, profile, variant: str = "app") -> Column:
    """User prompt: prediction, profile, then the variant's instruction and section headers."""
    t = PROMPTS[variant]
    head = F.concat(F.lit("Predicted crop: "), _c(crop), F.lit("\nProfile: "), _c(profile), F.lit("\n"))
    tail = t["user_tail"]
    if t["sections"]:
        tail = tail + "".join(f"{h}\n- ...\n" for h in t["sections"])
    return F.concat(head, F.lit(tail))


def system_prompt(variant: str = "app") -> Column:
    return F.lit(PROMPTS[variant]["system"])


# N12 -----------------------------------------------------------------------------------
def translate_prompt(text, language, strict: bool = False) -> Column:
    """Wrap text in the translation instruction; ``strict`` adds the retry prefix to the text."""
    body = F.concat(F.lit(TRANSLATE_RETRY_PREFIX), _c(text)) if strict else _c(text)
    return F.concat(F.lit("Translate the following Markdown into "), _s(language),
                    F.lit(".\n\nDo not add or remove content. Only translate.\n\n---\n"), body, F.lit("\n---"))


# N13 / N14 ------------------------------------------------------------------------------
def language_name(display) -> Column:
    """Display label → language name by prefix; anything else is English."""
    d = _c(display)
    out = F.lit("English")
    for name in reversed(["Hindi", "Kannada", "Telugu", "Tamil", "Malayalam"]):
        out = F.when(d.startswith(name), F.lit(name)).otherwise(out)
    return out


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def language_script(language) -> Column:
    return F.coalesce(F.element_at(_literal_map(LANGUAGE_SCRIPT), _c(language)), F.lit("Latin"))


def speech_code(language) -> Column:
    return F.coalesce(F.element_at(_literal_map(SPEECH_CODE), _c(language)), F.lit("en"))


# N15 / N16 ------------------------------------------------------------------------------
def letters_only(text) -> Column:
    """The text's letters (Unicode category L) in order; one linear regex pass."""
    return F.regexp_replace(_c(text), r"\P{L}+", "")


def letter_count(text) -> Column:
    return F.length(letters_only(text))


def script_letter_count(letters, script: str) -> Column:
    """Letters of ``letters`` (already letters only) inside the script's ranges."""
    if script not in SCRIPT_RANGES:
        return F.lit(0).cast("int")
    return F.length(F.regexp_replace(_c(letters), "[^" + script_class(script)[1:] + "+", ""))


def script_coverage(text, script, letters=None) -> Column:
    """Share of letters (Unicode category L) whose code point lies in the script's ranges.

    0.0 when the text has no letters or the script is unknown. ``script`` may be a fixed
    name or a column (each row then evaluates only its own script's pattern). Pass
    ``letters`` (a column from ``letters_only``) to share one letter pass over many checks.
    """
    lt = _c(letters) if letters is not None else letters_only(text)
    n = F.length(lt)
    if isinstance(script, str):
        inside = script_letter_count(lt, script).cast("double")
    else:
        inside = F.lit(0.0)
        for name in SCRIPT_RANGES:
            inside = F.when(script == name, script_letter_count(lt, name).cast("double")).otherwise(inside)
    return F.when(n > 0, inside / n).otherwise(F.lit(0.0))


def with_script_coverages(df, text: str, scripts=None, prefix: str = "cov_"):
    """Add one coverage column per script, sharing a single letters-only pass per row."""
    scripts = list(scripts or SCRIPT_RANGES)
    d = df.withColumn("_letters", letters_only(F.col(text)))
    return d.withColumns({f"{prefix}{s.lower()}": script_coverage(None, s, letters=F.col("_letters"))
                          for s in scripts}).drop("_letters")


def is_in_language(text, language) -> Column:
    """English always passes; otherwise coverage of the language's script >= 0.6."""
    lang = _s(language)
    cov = script_coverage(text, language_script(lang))
    return F.when(lang == "English", F.lit(True)).otherwise(cov >= F.lit(SCRIPT_MIN_COVERAGE))


# N17 -----------------------------------------------------------------------------------
def strip_markdown(md) -> Column:
    """Drop fenced code, unwrap inline code, drop heading and bullet marks, squeeze blank
    lines, trim. Line anchors follow only '\\n' (as in the reference)."""
    ws = whitespace_class("java")
    t = F.regexp_replace(_c(md), r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"(?md)^#+" + ws + "*", "")
    t = F.regexp_replace(t, r"(?md)^" + ws + "*[-*•]" + ws + "*", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"\A" + ws + "+|" + ws + r"+\z", "")


# SQL (DuckDB) forms used by the oracle ---------------------------------------------------
def sql_strip_markdown(expr: str) -> str:
    ws = whitespace_class("re2")
    t = f"regexp_replace({expr}, '(?s)```.*?```', '', 'g')"
    t = f"regexp_replace({t}, '`([^`]*)`', '\\1', 'g')"
    t = f"regexp_replace({t}, '(?m)^#+{ws}*', '', 'g')"
    t = f"regexp_replace({t}, '(?m)^{ws}*[-*•]{ws}*', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '\\A{ws}+|{ws}+\\z', '', 'g')"


def sql_letter_count(expr: str) -> str:
    return f"length(regexp_replace({expr}, '[^\\p{{L}}]', '', 'g'))"


def sql_script_letter_count(expr: str, script: str) -> str:
    rngs = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in SCRIPT_RANGES[script])
    letters = f"regexp_replace({expr}, '[^\\p{{L}}]', '', 'g')"
    return f"length(regexp_replace({letters}, '[^{rngs}]', '', 'g'))"


def sql_script_coverage(expr: str, script: str) -> str:
    n = sql_letter_count(expr)
    return (f"(CASE WHEN {n} > 0 THEN CAST({sql_script_letter_count(expr, script)} AS DOUBLE) / {n} "
            f"ELSE 0.0 END)")
