"""Line-first cleaning: rules judge every line, failing lines go, then documents that lose too much text go.

Three rules, none of which knows a language. Punctuation: markup debris, shouting, and short lines without an end mark.
Navigation: lines of items between bars, and furniture lines without an end mark. Boilerplate: lines that the document has
already had, and furniture lines with an end mark. Furniture are the lines that recur over the corpus: a line, its digits
apart, is one when it stands in many texts that are no copies of each other. Texts count as copies when they share the least
hash of their five-word runs, so a group of near copies, however large, makes no furniture of its own lines.

A null text has no lines; it and an empty text give zeros and are not kept. Repeated rows are judged alike, one result each,
and count once among the texts. An empty table gives an empty result. Columns of df but the id and the text are not read,
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain
from itertools import repeat as repeat_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hash_words, ship, slices, window_hashes, words_of, written

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_bad_punctuation long, n_bad_navigation long, n_bad_boilerplate long, kept_words long, clean_text string"
)
SYMBOLS, RUN = "#*$%&|<>", 5
NONE = np.empty(0, np.int64)
#: Marks that may end a sentence, with the quotes and brackets that may follow them.
TERMINAL = tuple(".!?…:;\"'”’»)]")
BARS = frozenset("| > » · • / - – :: ‹ › « →".split())
#: Ends of words in runs of marks or symbols: shouting and markup debris.
DEBRIS = re.compile(r"(?:[!?]{2,}|[#*$%&<>~^=_]{2,})[^\w\s]*(?!\S)")
MARKS = re.compile(r"[!?#*$%&<>~^=_]{2}")
SPACES = re.compile(r"[ \t\x0b\x0c\r]+")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_debris: float = 0.3
    min_bars: int = 3
    max_bars: float = 0.2
    short_line: int = 4
    max_loss: float = 0.5
    least_texts: int = 20  # unrelated texts that make a line furniture
    least_share: float = 0.5  # of the different texts with the line that must be unrelated
    most_sent: int = 1_000_000  # furniture lines up to which all tasks get them, 8 MB; more are joined to the texts, with the same verdicts


def line_fault(line: str, words: list[str], rules: Rules, debris: bool = True, furniture: bool = False) -> str | None:
    """The rule that a line with words fails: 'punctuation', 'navigation' or 'boilerplate'. debris: whether its document has any."""
    n = len(words)
    bars = 0 if BARS.isdisjoint(words) else sum(w in BARS for w in words)
    if bars >= rules.min_bars and bars > rules.max_bars * n:
        return "navigation"
    if debris and sum(1 for _ in DEBRIS.finditer(line)) > rules.max_debris * n:
        return "punctuation"
    ends = line.rstrip().endswith(TERMINAL)
    if n < rules.short_line and not ends:
        return "punctuation"
    if furniture:
        return "boilerplate" if ends else "navigation"
    return None


def judge(text: str | None, rules: Rules, keys: list[int] | None = None, furniture: np.ndarray = NONE) -> tuple:
    """Everything but doc_id of SCHEMA, for one text. keys: line_keys of its lines; furniture: those that are some, sorted."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces and nothing else
    n = len(words)
    repeat = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            first = [seen.setdefault(w, i) for i, w in enumerate(windows)]
            again = [i for i, j in enumerate(first) if i != j]
            starts = set(again) | {first[i] for i in again}
            repeat = len(set(chain.from_iterable((i, i + 1, i + 2) for i in starts)))
    text = text or ""
    lines, kept, faults, duplicates, kept_words = set(), [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0, 0
    count, debris = 0, MARKS.search(text) is not None
    known = np.isin(np.array(keys, np.int64), furniture).tolist() if keys and len(furniture) else repeat_(False)
    for line, found in zip(text.split("\n"), known, strict=False):
        parts = SPACES.split(line.strip(" \t\r\x0b\x0c"))
        if parts == [""]:
            continue
        count += 1
        twice = line in lines
        duplicates += twice
        lines.add(line)
        if fault := "boilerplate" if twice else line_fault(line, parts, rules, debris, found):
            faults[fault] += 1
        else:
            kept.append(line)
            kept_words += len(parts)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    verdict = not failed and n - kept_words <= rules.max_loss * n
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), duplicates, repeat, failed, verdict, count, *faults.values(), kept_words, "\n".join(kept))


def line_keys(text: Column) -> Column:
    """A hash of each line, spaces around it and the values of its digits apart; null for a line without words."""
    trimmed = lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(WORD), F.xxhash64(F.regexp_replace(trimmed(x), "[0-9]", "0"))))


def _relation(batches):
    """(text, least, keys): least, the smallest hash of the five-word runs, which copies share; shorter texts take all their words."""
    import pyarrow as pa

    for batch in batches:
        found = []
        for data, offsets, _ in slices(batch.column(0), batch.column(0)):
            start, end, doc = words_of(data, offsets)
            h = hash_words(data, start, end)
            n = len(offsets) - 1
            least = np.full(n, np.iinfo(np.int64).max, np.int64)
            runs = window_hashes(h, RUN).view(np.int64)
            inside = doc[: len(runs)] == doc[RUN - 1 :]
            np.minimum.at(least, doc[: len(runs)][inside], runs[inside])
            short = np.bincount(doc, minlength=n)[doc] < RUN
            total = np.zeros(n, np.uint64)
            np.add.at(total, doc[short], h[short])
            found.append(np.where(np.bincount(doc, minlength=n) < RUN, total.view(np.int64), least))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(found)), batch.column(2)], ["text", "least", "keys"])


def furniture_lines(df: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The keys of the lines that recur over the corpus, in a column `line`."""
    text = F.col(text_col).cast("string")
    rows = df.where(text.isNotNull()).select(text.alias("text"), F.xxhash64(text).alias("h"), F.array_distinct(F.filter(line_keys(text), lambda k: k.isNotNull())).alias("keys"))
    lines = rows.mapInArrow(_relation, "text long, least long, keys array<long>").select("text", "least", F.explode("keys").alias("line"))
    alike = lines.groupBy("line", "least", "text").agg(F.lit(1).alias("one")).groupBy("line", "least").agg(F.count("*").alias("texts"))
    counted = alike.groupBy("line").agg(F.count("*").alias("unrelated"), F.sum("texts").alias("texts"))
    return written(counted.where((F.col("unrelated") >= rules.least_texts) & (F.col("unrelated") >= rules.least_share * F.col("texts"))).select("line"))


def with_furniture(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """rows (text, keys, ...) with `known`, which of a text's keys are furniture, found by a join for furniture of any size.

    Each text takes part once, told by its SHA-256, however many rows have it.
    """
    rows = rows.withColumn("_text", F.unhex(F.sha2("text", 256)))
    keys = rows.groupBy("_text").agg(F.first("keys").alias("keys")).select("_text", F.explode(F.array_distinct("keys")).alias("line"))
    known = keys.join(lines, "line", "left_semi").groupBy("_text").agg(F.collect_list("line").alias("known"))
    return rows.join(known, "_text", "left").drop("_text")


def clean_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row of SCHEMA per row of df, on whole texts. clean_text holds the lines that passed."""
    ship(df.sparkSession)
    lines = furniture_lines(df, text_col, rules)
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), line_keys(text).alias("keys"))
    if lines.count() <= rules.most_sent:
        sent = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r.line for r in lines.toLocalIterator()], np.int64)))
        rows = rows.withColumn("known", F.lit(None).cast("array<long>"))
    else:
        sent, rows = None, with_furniture(rows, lines)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 5 + [pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, known = part.column(2).to_pylist(), part.column(3).to_pylist()
                furniture = [sent.value if sent else np.array(k or [], np.int64) for k in known]
                judged = [judge(t.as_py(), rules, None if k is None else [x or 0 for x in k], f) for t, k, f in zip(part.column(1), keys, furniture, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*judged, strict=True), kinds[1:])], names)

    return rows.select("doc_id", "text", "keys", "known").mapInArrow(run, SCHEMA)
