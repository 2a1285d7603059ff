"""Line-first quality rules, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed, and a document that
loses more than MAX_LOSS percent of its word characters is rejected, besides the base rules (too few words, too many
words in repeated three-word windows). No shuffle: every figure is computed within its row.

Defined results: a null text has no words and fails the base rules; repeated rows are judged each for itself; an empty
table gives an empty table; other columns pass through, and a clashing name gets a leading underscore on the operator's
column. Windows are compared by 64-bit hashes of their words, within one text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import fresh

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&|<>{}=~^_\\"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words
MAX_LOSS = 50  # percent of word characters
#: Phrases of boilerplate and navigation lines, in lower case: parameters of the rules.
BOILERPLATE = r"all rights reserved|cookie policy|privacy policy|terms of (use|service)|javascript is (disabled|required)|subscribe to our newsletter|click here|sign in to continue|lorem ipsum"
NAVIGATION = r"^\W*(home|menu|search|login|log in|sign up|next|previous|back|share|skip to content|contact us|about us)\W*$"
FIELDS = r"^[^|»>]{1,25}([|»>][^|»>]{1,25}){2,}$"


def line_fails(line: Column) -> Column:
    """Punctuation: symbols are over a fifth of the line's word characters. Navigation: a menu word alone, or three or
    more short fields parted by bars or arrows. Boilerplate: a listed phrase."""
    solid = F.length(F.translate(line, SPACES, ""))
    symbols = solid - F.length(F.translate(line, SPACES + LINE_SYMBOLS, ""))
    low = F.lower(line)
    return (symbols * 5 > solid) | low.rlike(NAVIGATION) | low.rlike(FIELDS) | low.rlike(BOILERPLATE)


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text, clean_chars, base_failed and kept."""
    name = {n: fresh(df.columns, n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "clean_chars", "base_failed", "kept")}
    t, w, lines, h, o, at = (fresh(df.columns, f"tmp_{x}") for x in ("text", "words", "lines", "hashes", "order", "at"))
    own = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    step = step.withColumns({w: F.filter(F.split(t, SPACE), lambda x: x != ""), lines: F.split(t, "\n")})
    step = step.withColumn(
        h, F.expr(f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))")
    )
    # Only texts with a window found twice are put in order; equal windows are then neighbours.
    step = step.withColumn(o, F.expr(f"if(size(array_distinct({h})) = size({h}), array(), sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i))))"))
    step = step.withColumn(
        at,
        F.expr(f"sort_array(transform(filter({o}, (x, k) -> coalesce(get({o}, k - 1).h = x.h, false) OR coalesce(get({o}, k + 1).h = x.h, false)), x -> x.i))"),
    )
    covered = F.expr(f"aggregate({at}, struct(0L AS n, 0 AS upto), (a, x) -> struct(a.n + x + 3 - greatest(a.upto, x) AS n, x + 3 AS upto), a -> a.n)")
    solid_lines = F.filter(lines, lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = step.withColumns({
        name["n_words"]: F.size(w).cast("long"),
        name["word_chars"]: F.length(F.translate(t, SPACES, "")).cast("long"),
        name["n_symbols"]: (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        name["n_dup_lines"]: (F.size(solid_lines) - F.size(F.array_distinct(solid_lines))).cast("long"),
        name["n_repeat_words"]: covered,
        name["clean_text"]: F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n"),
    })
    step = step.withColumns({
        name["clean_chars"]: F.length(F.translate(name["clean_text"], SPACES, "")).cast("long"),
        name["base_failed"]: (F.col(name["n_words"]) < MIN_WORDS) | (100 * F.col(name["n_repeat_words"]) > MAX_REPEATED * F.col(name["n_words"])),
    })
    keeps = F.col(name["clean_chars"]) * 100 >= F.col(name["word_chars"]) * (100 - MAX_LOSS)
    return step.select(*own, *(name[n] for n in list(name)[:-1]), (~F.col(name["base_failed"]) & keeps).alias(name["kept"]))


#: The same in DuckDB's SQL, for the query's columns.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
p AS (SELECT rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, line, translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS solid FROM l),
lines AS (SELECT rid, count(*) FILTER (WHERE solid <> '') - count(DISTINCT line) FILTER (WHERE solid <> '') AS dup,
    coalesce(sum(length(solid)) FILTER (WHERE NOT (
        (length(solid) - length(translate(solid, '{LINE_SYMBOLS}', ''))) * 5 > length(solid)
        OR regexp_matches(lower(line), '{NAVIGATION}') OR regexp_matches(lower(line), '{FIELDS}') OR regexp_matches(lower(line), '{BOILERPLATE}'))), 0) AS clean
    FROM lw GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, lines.dup::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words, lines.clean::BIGINT AS clean_chars
    FROM w JOIN lines USING (rid) LEFT JOIN cover USING (rid))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND clean_chars * 100 >= word_chars * {100 - MAX_LOSS} AS kept
FROM f
"""
