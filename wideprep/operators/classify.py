"""Feature classification (CL1-CL3, JN2, TX6).

Priority per column: (a) a hint table ``(key, kind)`` matched on the
normalised name; (b) name cues: exactly one class of patterns hits the name,
else a substring cue -> categorical; (c) data: the numeric share of all rows,
integer-likeness and distinct counts from one profiling job, run only for
undecided columns.  Names are metadata (bounded by #columns) and handled on
the driver; data facts come from Spark jobs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideprep.functions.numeric import to_number
from wideprep.functions.text import match_key, py_match_key, regex_any
from wideprep.operators import profile as P
from wideprep.operators._util import col

# The reference's default cue patterns (Russian medical
# vocabulary), matched case-insensitively on the normalised name or text.
CATEGORICAL_PATTERNS = [
    r"\(.*?\b1\s*[-–]\s*.*?\)",
    r"\bда\s*[-=]?\s*1\b",
    r"\bнет\s*[-=]?\s*2\b",
    r"\bгруппа\b",
    r"\bтип\b",
    r"\bкатегор",
    r"\bстепень\b",
    r"\bстадия\b",
]
NUMERICAL_PATTERNS = [
    r"\bкг\b",
    r"\bмм\s*рт\.?\s*ст\.?\b",
    r"\bмг\s*/\s*дл\b",
    r"\bг\s*/\s*л\b",
    r"\bсад\b",
    r"\bдад\b",
    r"\bкреатинин\b",
    r"\bобщий\s+белок\b",
    r"\bwbc[-\s]*лейкоцит",
]
CATEGORICAL_CUES = ["(да-1", "(1 -", "группа", "тип", "категория", "степень", "стадия"]

# Thresholds of the data heuristic.
NUMERIC_SHARE = 0.90
MAX_CATEGORIES = 10
BORDERLINE_MIN = 5


def _hits(patterns, s):
    return any(re.search(p, s, flags=re.IGNORECASE) for p in patterns)


def name_kind(key: str, cat_patterns, num_patterns, cues, use_patterns=True):
    """(b) on one normalised, case-folded name: ``categorical``/``numerical``/None."""
    if use_patterns:
        c, n = _hits(cat_patterns, key), _hits(num_patterns, key)
        if c and not n:
            return "categorical"
        if n and not c:
            return "numerical"
    if any(k in key for k in cues):
        return "categorical"
    return None


def text_cues(df: DataFrame, text_col: str, cat_patterns=None, num_patterns=None, cues=None) -> DataFrame:
    """TX6/CL3 over a text column: ``cat_hit, num_hit, cue_hit, kind`` where kind is
    the class whose patterns alone hit (NULL when both or none)."""
    cat_patterns = CATEGORICAL_PATTERNS if cat_patterns is None else cat_patterns
    num_patterns = NUMERICAL_PATTERNS if num_patterns is None else num_patterns
    cues = CATEGORICAL_CUES if cues is None else cues
    key = match_key(text_col)
    # one alternation per class: one scan of the (whole) text per class
    cat, num = regex_any(key, [_alternation(cat_patterns)] if cat_patterns else []), \
        regex_any(key, [_alternation(num_patterns)] if num_patterns else [])
    cue = F.lit(False)
    for k in cues:
        cue = cue | (F.instr(key, k) > 0)
    hits = df.select("*", cat.alias("cat_hit"), num.alias("num_hit"), cue.alias("cue_hit"))
    kind = F.when(F.col("cat_hit") & ~F.col("num_hit"), F.lit("categorical")) \
        .when(F.col("num_hit") & ~F.col("cat_hit"), F.lit("numerical"))
    return hits.withColumn("kind", kind)


def _alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def hints_from_report(lines: DataFrame, name_col: str = "name", desc_col: str = "description",
                      cat_patterns=None, num_patterns=None) -> DataFrame:
    """CL3: ``key, kind`` from a report with names and descriptions: the class
    whose patterns alone hit the description."""
    cued = text_cues(lines.select(col(name_col).alias("_n"), col(desc_col).alias("_d")), "_d",
                     cat_patterns, num_patterns, cues=[])
    # keep decided rows with a generator, not a filter: a filter would be pushed
    # below the projection and re-evaluate the whole-text cues once per reference
    item = F.struct(match_key("_n").alias("key"), F.col("kind").alias("kind"))
    keep = F.when(F.col("kind").isNotNull() & (match_key("_n") != ""), F.array(item)).otherwise(F.array())
    return cued.select(F.explode(keep).alias("h")).select("h.key", "h.kind")


def data_facts(df: DataFrame, columns) -> dict:
    """One job: numeric share of all rows, integer-likeness, distinct counts of
    the coerced numbers and of the raw values."""
    if not columns:
        return {}
    from wideprep.functions.numeric import NUMERIC_TYPES
    types = {f.name: f.dataType for f in df.schema.fields}
    ratio = {r["column"]: r for r in P.numeric_ratio(df, columns).collect()}
    # raw and numeric distinct counts from one frequency table: to_number runs on
    # the distinct texts only
    numeric = [c for c in columns if isinstance(types[c], NUMERIC_TYPES)]
    freq = P.frequency_table(df, columns)
    numv = F.when(F.col("column").isin(numeric), F.col("num")).otherwise(to_number(F.col("value")))
    dist = {r["column"]: r for r in freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_distinct(numv).alias("n_num")).collect()}
    return {c: {"ratio": ratio[c]["ratio_numeric"], "int_like": ratio[c]["int_like"],
                "n_num": dist[c]["n_num"] if c in dist else 0, "n_raw": dist[c]["n_raw"] if c in dist else 0}
            for c in columns}


def classify_features(df: DataFrame, hints: DataFrame | None = None, use_patterns: bool = True,
                      cat_patterns=None, num_patterns=None, cues=None, columns=None) -> DataFrame:
    """CL1 (``use_patterns=True``) / CL2 (``False``): ``position, column, kind,
    source, high_card, borderline``."""
    cat_patterns = CATEGORICAL_PATTERNS if cat_patterns is None else cat_patterns
    num_patterns = NUMERICAL_PATTERNS if num_patterns is None else num_patterns
    cues = CATEGORICAL_CUES if cues is None else cues
    names = list(columns or df.columns)
    hint_map = {}
    if hints is not None:
        # JN2: hint keys are normalised the same way as names; the hint table is small config
        for r in hints.select(match_key("key").alias("k"), "kind").collect():
            hint_map.setdefault(r["k"], r["kind"])
    decided = {}
    for c in names:
        k = py_match_key(c)
        if k in hint_map:
            decided[c] = (hint_map[k], "hints")
            continue
        nk = name_kind(k, cat_patterns, num_patterns, cues, use_patterns)
        if nk:
            decided[c] = (nk, "name")
    rest = [c for c in names if c not in decided]
    facts = data_facts(df, rest)
    rows = []
    for i, c in enumerate(names):
        high, border = False, False
        if c in decided:
            kind, src = decided[c]
        else:
            f = facts[c]
            src = "heuristic"
            if f["ratio"] >= NUMERIC_SHARE:
                if f["n_num"] == 0:
                    kind = "categorical"
                elif f["int_like"] and f["n_num"] <= MAX_CATEGORIES:
                    kind = "categorical"
                    border = f["n_num"] > BORDERLINE_MIN
                else:
                    kind = "numerical"
            else:
                kind = "categorical"
                high = f["n_raw"] > MAX_CATEGORIES
                border = BORDERLINE_MIN < f["n_raw"] <= MAX_CATEGORIES
        rows.append((i, c, kind, src, high, border))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, kind string, source string, high_card boolean, borderline boolean")
