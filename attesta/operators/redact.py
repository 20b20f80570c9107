"""Secret redaction over text tables: redact, log, and corpus report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from attesta import rules
from attesta.functions.text import contains_any, unicode_regex

# Words of which a text must hold at least one (case folded) before the rule at the same position can match.
# Replacements only insert bracketed marks, so a word missing from the original stays missing at every stage.
_PATTERN_WORDS = (
    ("api_key", "api-key", "apikey", "api_secret"), ("secret", "token", "bearer"), ("password", "passwd", "pwd"),
    ("aws",), ("akia",), ("postgres://", "mysql://", "mongodb://", "redis://", "mssql://"), ("private key-----",),
    ("10.", "172.", "192.168."), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("xox",), ("sk-ant-",), ("sk-",),
)


@dataclass(frozen=True)
class RedactionRules:
    """The rules of one pass; defaults are the built-in lists in declaration order."""

    extra_patterns: tuple[str, ...] = ()
    extra_files: tuple[str, ...] = ()
    keywords: tuple[str, ...] = rules.SENSITIVE_KEYWORDS
    max_length: int | None = None
    strict_private_ip: bool = False

    @property
    def patterns(self) -> tuple[str, ...]:
        base = list(rules.SECRET_PATTERNS)
        if self.strict_private_ip:
            base[7] = rules.STRICT_PRIVATE_IP
        return tuple(base) + self.extra_patterns


def rules_for_language(language: str, **kwargs) -> RedactionRules:
    """Add a language's secret rules: those with regex characters are patterns, the rest file names."""
    profile = rules.LANGUAGES.get(language.lower())
    if profile is None:
        raise ValueError(f"Unknown language '{language}'. Supported: {', '.join(rules.LANGUAGES)}")
    regexes = tuple(p for p in profile["secrets"] if set(p) & set("()*+?[]{}|\\"))
    names = tuple(p for p in profile["secrets"] if p not in regexes)
    return RedactionRules(extra_patterns=regexes, extra_files=names, **kwargs)


def pattern_regex(pattern: str) -> str:
    return "(?md)" + unicode_regex(pattern)


def keyword_regex(keyword: str) -> str:
    return "(?iu)" + unicode_regex(rf"\b\w*{keyword}\w*\s*[=:]\s*[\"']?[^\"'\s\n]+[\"']?")


# The letters besides the ASCII ones that case-insensitive matching equates with an ASCII letter; lower() folds the
# Kelvin sign by itself.
_FOLDS = (("ſ", "s"), ("ı", "i"), ("İ", "i"))


def _folded_sql(text: str) -> str:
    for letter, plain in _FOLDS:
        text = f"replace({text}, '{letter}', '{plain}')"
    return f"lower({text})"


def _folded_case(text: Column) -> Column:
    for letter, plain in _FOLDS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _steps(ruleset: RedactionRules) -> list[tuple[str, str, tuple[str, ...] | None]]:
    """(regex, replacement, gate words) in the order the rules apply; no words means no gate."""
    gates = _PATTERN_WORDS + (None,) * len(ruleset.extra_patterns)
    steps = [(pattern_regex(p), "[REDACTED]", g) for p, g in zip(ruleset.patterns, gates)]
    # An extra pattern's mark cannot spell a keyword, so keyword gates hold on the original text too.
    return steps + [(keyword_regex(k), f"[{k.upper()}_REDACTED]", (k,)) for k in ruleset.keywords]


_NEVER = "(?!)"


def redact_text(text: Column, ruleset: RedactionRules = RedactionRules()) -> Column:
    """The redacted text as one expression, for use inside ``transform``.

    The folded text is bound once; a rule whose words are missing gets a pattern that fails at once.
    """
    def fold(bound: Column) -> Column:
        out = bound["text"]
        for regex, mark, words in _steps(ruleset):
            pattern = F.lit(regex) if words is None else F.when(
                contains_any(bound["folded"], words), F.lit(regex)).otherwise(F.lit(_NEVER))
            out = F.regexp_replace(out, pattern, F.lit(mark))
        return out

    both = F.array(F.struct(text.alias("text"), _folded_case(text).alias("folded")))
    return F.transform(both, fold)[0]


def _any_word(words: Sequence[str] | None) -> str:
    return "(" + " OR ".join(f"contains(_folded, '{w}')" for w in words) + ")" if words else "true"


def _fold(df: DataFrame, text: str, steps: Sequence[tuple[str, str, str]], count: bool) -> DataFrame:
    """Apply (regex, mark, condition) steps in order to ``text``; adds ``_t`` and, on request, counts ``_n<i>``.

    One nested projection per step: each stage's text is computed once and read twice (count, replace), and a regex
    runs only where its condition holds. Written as one SQL text because it is analysed once, not once per step.
    """
    sql, args = f"SELECT *, `{text}` AS _t, {_folded_sql(f'`{text}`')} AS _folded FROM {{df}}", {}
    for i, (regex, mark, when) in enumerate(steps):
        args |= {f"p{i}": regex, f"m{i}": mark}
        counted = f"CASE WHEN {when} THEN regexp_count(_t, :p{i}) ELSE 0 END AS _n{i}, " if count else ""
        sql = (f"SELECT * EXCEPT (_t), {counted}"
               f"CASE WHEN {when} THEN regexp_replace(_t, :p{i}, :m{i}) ELSE _t END AS _t FROM ({sql})")
    return df.sparkSession.sql(f"SELECT * EXCEPT (_folded) FROM ({sql})", args, df=df)


def _sql_steps(ruleset: RedactionRules) -> list[tuple[str, str, str]]:
    return [(regex, mark, _any_word(words)) for regex, mark, words in _steps(ruleset)]


def truncate_text(text: Column, limit: int | None = rules.MAX_TEXT) -> Column:
    """The first ``limit`` characters and a note of how many are gone; no limit leaves the text whole."""
    if limit is None:
        return text
    cut = F.concat(F.substring(text, 1, limit), F.lit("\n\n... [TRUNCATED: "),
                   (F.length(text) - limit).cast("string"), F.lit(" characters removed]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def is_sensitive_file(path: Column, extra: Sequence[str] = ()) -> Column:
    return contains_any(F.lower(path), [*rules.SENSITIVE_FILES, *(e.lower() for e in extra)])


def redact(df: DataFrame, text: str = "text", path: str | None = None,
           ruleset: RedactionRules = RedactionRules(), out: str = "sanitized") -> DataFrame:
    """Redact, then truncate where the rules say so; with ``path``, whole files with sensitive names are replaced."""
    clean = truncate_text(F.col("_t"), ruleset.max_length)
    if path is not None:
        marker = F.concat(F.lit("[FILE CONTENTS REDACTED: "), F.col(path), F.lit("]"))
        clean = F.when(is_sensitive_file(F.col(path), ruleset.extra_files), marker).otherwise(clean)
    folded = _fold(df, text, _sql_steps(ruleset), count=False)
    return folded.withColumn(out, clean).drop("_t")


def redact_by_language(df: DataFrame, text: str, language: str, path: str) -> DataFrame:
    """Redact a corpus of mixed languages: each row also sees its own language's patterns and file names."""
    sensitive, extras = is_sensitive_file(F.col(path)), []
    for name in rules.LANGUAGES:
        extra = rules_for_language(name)
        extras += [(pattern_regex(p), "[REDACTED]", f"lower(`{language}`) = '{name}'") for p in extra.extra_patterns]
        if extra.extra_files:
            named = contains_any(F.lower(F.col(path)), [f.lower() for f in extra.extra_files])
            sensitive = sensitive | ((F.lower(F.col(language)) == name) & named)
    steps, n = _sql_steps(RedactionRules()), len(rules.SECRET_PATTERNS)
    out = _fold(df, text, steps[:n] + extras + steps[n:], count=False)
    marker = F.concat(F.lit("[FILE CONTENTS REDACTED: "), F.col(path), F.lit("]"))
    clean = F.when(sensitive, marker).otherwise(F.col("_t"))
    return out.withColumn("sanitized", clean).drop("_t")


def rule_names(ruleset: RedactionRules = RedactionRules()) -> list[str]:
    return [f"Pattern {i + 1}" for i in range(len(ruleset.patterns))] + \
           [f"Keyword '{k}'" for k in ruleset.keywords]


def redact_with_log(df: DataFrame, text: str = "text", path: str | None = None,
                    ruleset: RedactionRules = RedactionRules()) -> DataFrame:
    """Adds ``sanitized``, ``redactions`` (ordered log) and ``was_modified``."""
    keep = df.columns
    folded = _fold(df, text, _sql_steps(ruleset), count=True)
    counts = [f"_n{i}" for i in range(len(ruleset.patterns) + len(ruleset.keywords))]
    n_patterns = len(ruleset.patterns)
    entries = [F.when(F.col(c) > 0, F.concat(F.lit(f"Pattern {i + 1}: "), F.col(c).cast("string"),
                                            F.lit(" match(es) redacted")))
               for i, c in enumerate(counts[:n_patterns])]
    entries += [F.when(F.col(c) > 0, F.lit(f"Keyword '{k}' redacted"))
                for k, c in zip(ruleset.keywords, counts[n_patterns:])]
    size = F.length("_t")
    if ruleset.max_length is not None:
        entries.append(F.when(size > ruleset.max_length, F.concat(
            F.lit("Truncated from "), size.cast("string"), F.lit(f" to {ruleset.max_length} characters"))))
    log, clean = F.array_compact(F.array(*entries)), truncate_text(F.col("_t"), ruleset.max_length)
    if path is not None:
        hit = is_sensitive_file(F.col(path), ruleset.extra_files)
        log = F.when(hit, F.array(F.concat(F.lit("Entire file redacted: "), F.col(path)))).otherwise(log)
        clean = F.when(hit, F.concat(F.lit("[FILE CONTENTS REDACTED: "), F.col(path), F.lit("]"))).otherwise(clean)
    return (folded.select(*keep, clean.alias("sanitized"), log.alias("redactions"))
            .withColumn("was_modified", F.size("redactions") > 0))


def redaction_report(df: DataFrame, text: str = "text", ruleset: RedactionRules = RedactionRules()) -> DataFrame:
    """One row per rule, rules without hits included: hits, files touched, share of files touched.

    All counters are one partial aggregate; only a single row is turned into the rule table.
    """
    folded = _fold(df.select(text), text, _sql_steps(ruleset), count=True)
    names = rule_names(ruleset)
    counts = [f"_n{i}" for i in range(len(names))]
    totals = folded.agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"h{i}") for i, c in enumerate(counts)],
        *[F.count_if(F.col(c) > 0).alias(f"f{i}") for i, c in enumerate(counts)])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"h{i}").cast("bigint").alias("hits"),
                               F.col(f"f{i}").alias("files")) for i, n in enumerate(names)])
    return (totals.select("n_files", F.explode(cells).alias("c"))
            .select("c.rule", "c.hits", "c.files",
                    F.coalesce(F.try_divide(F.col("c.files"), F.col("n_files")), F.lit(0.0)).alias("share")))


def _emoji_class() -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in rules.EMOJI_RANGES) + "]+"


EMOJI = _emoji_class()


def strip_emoji(text: Column) -> Column:
    """Remove runs of the listed code-point ranges (U+24C2 to U+1F251 covers most CJK as well)."""
    return F.regexp_replace(text, EMOJI, "")


def strip_emoji_nested(col: Column, dtype) -> Column:
    """Apply :func:`strip_emoji` to every string inside a column of a known type; map keys stay."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.StringType):
        return strip_emoji(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: strip_emoji_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: strip_emoji_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [strip_emoji_nested(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col
