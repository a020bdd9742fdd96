"""Line-first quality rules: drop lines that break a rule, then reject documents that lost too much text.

Each line is judged on its own by its words (``[^\\x20\\x09-\\x0D]+``): no word that closes a sentence, navigation separators,
shouting, symbols, boilerplate phrases, or one word over and over. Failing lines go; a document is rejected if it fails
the base rule (under 50 words, or over half of its words in 3-word windows that recur) or if the failing lines held over
half of its word characters. One pass, no shuffle; memory is one document's words.

Results: a null or empty text has no words, so it fails the base rule; lines without words pass and count for nothing;
equal lines count as duplicates from the second on; repeated rows are judged each on their own; an empty table gives an
empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import _common as C

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?…:;\"')»”"
SEPARATORS = ("|", "»", "›", "·", "•", ">", "/")
BOILERPLATE = (
    "all rights reserved", "cookie", "terms of use", "terms of service", "privacy policy", "licensed under", "released under",
    "is licensed", "copyright", "javascript", "subscribe", "sign in", "log in", "click here", "lorem ipsum",
)
MIN_WORDS = 50
RULES = ("punctuation", "navigation", "shouting", "symbols", "boilerplate", "repetition")

_symbols = re.compile(f"[{re.escape(SYMBOLS)}]")
_boiler = re.compile("|".join(map(re.escape, BOILERPLATE)))


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks; bytes.split splits at just those."""
    return [w.decode() for w in text.encode().split()]


def line_fault(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words breaks."""
    n = len(words)
    if not any(w[-1] in CLOSING for w in words):
        return "punctuation"
    if (k := sum(w in SEPARATORS for w in words)) >= 2 and 5 * k >= n:
        return "navigation"
    if 2 * sum(w.endswith("!!") for w in words) > n:
        return "shouting"
    if 3 * len(_symbols.findall(line)) > n:
        return "symbols"
    if _boiler.search(line.lower()):
        return "boilerplate"
    if n >= 4 and 2 * sum(a == b for a, b in zip(words, words[1:])) > n:
        return "repetition"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 1 << 20:  # three ids no longer fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def judge(text: str, max_lost: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, kept lines joined)."""
    lines, seen, good = text.split("\n"), set(), []
    every: list[str] = []
    lost = dup = 0
    for line in lines:
        words = words_of(line)
        if words:
            dup += line in seen
            seen.add(line)
            every += words
            if line_fault(line, words):
                lost += sum(map(len, words))
                continue
        good.append(line)
    chars, repeat = len(text) - sum(map(text.count, BLANKS)), repeated_words(every)
    failed = len(every) < MIN_WORDS or 100 * repeat > 50 * len(every)
    return len(every), chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, lost, not failed and lost <= max_lost * chars, "\n".join(good)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_chars long, kept boolean, clean_text string"


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """The columns ``keep`` of each row and its measures, verdict and cleaned text (null unless ``with_text``)."""

    def make():
        types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]

        def f(batch):
            found = [judge(x, max_lost) for x in C.texts(batch, "__text")]
            columns = [list(x) for x in zip(*found)]
            if not with_text:
                columns[-1] = [None] * batch.num_rows
            arrays = [batch.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

        return f

    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    names = [*keep, *(x.split()[0] for x in SCHEMA.split(", "))]
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return C.map_batches(rows, make, f"{kept}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.documents(spark, sf_dir), with_text=False).drop("clean_text", "lost_chars")


_Q = "'" + CLOSING.replace("'", "''") + "'"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lw AS (SELECT rid, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM ln),
lf AS (
  SELECT rid, pos, line, w, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    len(list_filter(w, lambda x: contains({_Q}, right(x, 1)))) = 0
    OR (len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) >= 2
        AND 5 * len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) >= len(w))
    OR 2 * len(list_filter(w, lambda x: ends_with(x, '!!'))) > len(w)
    OR 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) > len(w)
    OR regexp_matches(lower(line), '{"|".join(BOILERPLATE)}')
    OR (len(w) >= 4 AND 2 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > len(w)) AS bad
  FROM lw WHERE len(w) > 0),
dl AS (SELECT rid, sum(n - 1) AS dup FROM (SELECT rid, line, count(*) AS n FROM lf GROUP BY ALL) GROUP BY rid),
lost AS (SELECT rid, sum(chars) FILTER (bad) AS lost FROM lf GROUP BY rid),
aw AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text, doc_id FROM d),
wn AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM aw WHERE len(w) >= 3),
tri AS (SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM wn),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri) WHERE k > 1),
cov AS (SELECT rid, count(DISTINCT p + o) AS r FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    coalesce(lost, 0) AS lost
  FROM aw LEFT JOIN dl USING (rid) LEFT JOIN lost USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= word_chars AS kept
FROM m
"""
