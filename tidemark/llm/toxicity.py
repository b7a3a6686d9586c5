"""Toxicity: a lexicon trie searched by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: words, and stems with many endings, that toxic documents hold far more often.
The classifier over the hits is a logistic regression. Both see a bounded sample of labelled rows (`Limits`); lang, source
and ids are no inputs. Then every document is scored whole, in one pass without a shuffle.

A word matches an entry of the trie when an automaton of the word accepts it with at most one edit (two for long words).
Hits in quotation marks, or near words of reporting, count apart.

Null and empty texts have no words and get the score of a document without hits. Without labels of both kinds every score
is the share of toxic labels (0 without labels). Repeated rows are scored alike, one result each. An empty table gives an
empty result. Columns of df named like the new ones (FEATURES, score, predicted) are replaced, others are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

TOKEN = re.compile(r"[^\W_]+")
SPLIT = r"[^\p{L}\p{N}]+"
#: A quotation of any length within a line.
QUOTED = re.compile(r"“[^“”\n]++”|«[^«»\n]++»|„[^„“”\n]++[“”]|\"[^\"\n]++\"")
REPORTING = frozenset("said says wrote quote quoted quoting reported word term called dijo escribió palabra dit écrit mot sagte schrieb wort zitat".split())
#: Log weights of exact, misspelled and quoted hits, hits per hundred words, any exact hit.
FEATURES = ["tox_exact", "tox_fuzzy", "tox_quoted", "tox_density", "tox_any"]
WINDOW = 6
MEMO = 400_000


@dataclass(frozen=True)
class Limits:
    """Bounds of what is learned from, labelled documents of either kind, and the evidence that an entry takes."""

    toxic_rows: int = 4000
    clean_rows: int = 8000
    least_documents: int = 3
    least_odds: float = 1.8  # log odds less 1.5 standard errors


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0, 0.0, 0.0, 0.0])


def edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """Words and stems with their weights; search() walks it along an automaton of the word asked for."""

    def __init__(self, model: Model):
        self.root: dict = {}
        for kind, entries in (("word", model.words), ("stem", model.stems)):
            for entry, weight in entries.items():
                node = self.root
                for c in entry:
                    node = node.setdefault(c, {})
                node[kind] = weight
        # A word within k edits of an entry holds one of its k + 1 pieces unchanged, at most k places off; exact entries too.
        self.pieces: dict[int, dict[int, set[str]]] = {}
        for entry in model.words:
            k = edits(len(entry))
            if k:
                bounds = [len(entry) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    for shift in range(-k, k + 1):
                        if a + shift >= 0:
                            self.pieces.setdefault(a + shift, {}).setdefault(b - a, set()).add(entry[a:b])
        self.flat = [(at, n, found) for at, by in self.pieces.items() for n, found in by.items()]
        self.lengths = {len(w) + d for w in model.words for d in range(-edits(len(w)), edits(len(w)) + 1)}
        self.words = model.words

    def search(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best entry that the word's automaton accepts, or None."""
        if (w := self.words.get(word)) is not None:
            return w, 0
        node, n = self.root, len(word)
        for c in word:
            if (node := node.get(c)) is None:
                break
            if (w := node.get("stem")) is not None:
                return w, 0
        if n < 4 or n not in self.lengths or not any(word[at : at + m] in found for at, m, found in self.flat):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        most, full, best = edits(n + 2), 1 << n, None  # entries have two letters more at most
        stack = [(self.root, tuple((1 << e + 1) - 1 for e in range(most + 1)), 0)]
        while stack:
            node, states, depth = stack.pop()
            if (w := node.get("word")) is not None:
                allowed = edits(depth)
                hit = next((e for e, s in enumerate(states[: allowed + 1]) if s & full), None)
                if hit is not None and (best is None or (hit, -w) < (best[1], -best[0])):
                    best = (w, hit)
            for c, child in node.items():
                if len(c) != 1:
                    continue
                mask, last_old, last_new, new = masks.get(c, 0), 0, 0, []
                for e, s in enumerate(states):
                    step = (s & mask) << 1
                    if e:  # an edit more: skip c, put c for a letter, or skip a letter
                        step |= last_old | last_old << 1 | last_new << 1
                    step &= (full << 1) - 1
                    new.append(step)
                    last_old, last_new = s, step
                if any(new):
                    stack.append((child, tuple(new), depth + 1))
        return best


def features(text: str, trie: Trie, memo: dict) -> list[float]:
    """Weights of exact, misspelled and quoted hits (log scale), hits per hundred words, and any hit at all."""
    exact = fuzzy = quoted = 0.0
    hits, n, recent = 0, 0, -WINDOW - 1
    spans = None
    low = text.lower()
    for n, m in enumerate(TOKEN.finditer(low), 1):  # noqa: B007
        word = m[0]
        if word in memo:
            found = memo[word]
        else:
            if len(memo) > MEMO:
                memo.clear()
            found = memo[word] = trie.search(word)
        if word in REPORTING:
            recent = n
        if found is None:
            continue
        hits += 1
        if spans is None:
            spans = [s.span() for s in QUOTED.finditer(low)]  # in order and apart
        at = bisect_left(spans, (m.start(), 0)) - 1
        if n - recent <= WINDOW or (at >= 0 and m.start() < spans[at][1]):
            quoted += found[0]
        elif found[1]:
            fuzzy += found[0]
        else:
            exact += found[0]
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), min(10.0, 100.0 * hits / max(n, 20)), float(exact > 0)]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps; the first coefficient is the constant's and isn't shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (weight * (y - p)) - shrink @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(df: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """df: (doc_id, text); labels: (doc_id, toxic), only rows that may be learned from."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.xxhash64(F.lit(6), "doc_id")
    sample = marks.where("toxic = 1").orderBy(chosen, "doc_id").limit(limits.toxic_rows).unionByName(marks.where("toxic = 0").orderBy(chosen, "doc_id").limit(limits.clean_rows))
    of = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    model = Model()
    share = of.get(1, 0) / max(1, sum(of.values()))
    model.weights[0] = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not of.get(0) or not of.get(1):
        return model
    words = F.filter(F.split(F.lower("text"), SPLIT), lambda w: F.length(w) > 2)
    # Bounded by the limits: of rows that share an id the least text counts. The words are made once.
    found = df.join(F.broadcast(sample), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = found.select("text", "toxic", words.alias("w")).persist()
    # Near copies count once: they share the least hash of their three-word runs.
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i + 1, 3))))
    seen = texts.where("size(w) > 0").select("toxic", F.array_min(run).alias("copy"), F.array_distinct("w").alias("w")).persist()
    totals = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.countDistinct("copy").alias("n")).collect()}
    toxic_n, clean_n = totals.get(1, 0), totals.get(0, 0)
    each = seen.select("toxic", "copy", F.explode("w").alias("w")).distinct().groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).persist()

    def evident(rows: DataFrame) -> dict[str, float]:
        odds = F.log((F.col("t") + 0.5) / (toxic_n + 1)) - F.log((F.col("c") + 0.5) / (clean_n + 1))
        doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))  # its standard error
        rows = rows.where(F.col("t") >= limits.least_documents).withColumn("odds", odds).where(F.col("odds") - 1.5 * doubt >= limits.least_odds)
        return {r.entry: float(r.odds) for r in rows.select("entry", "odds").toLocalIterator()}  # of the bounded sample's words

    starts = F.transform(F.sequence(F.lit(4), F.least(F.length("w"), F.lit(7))), lambda n: F.substring(F.col("w"), F.lit(1), n))
    stems = each.where("length(w) >= 5").select("t", "c", F.explode(starts).alias("entry")).groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("forms"))
    model.words = evident(each.withColumnRenamed("w", "entry"))
    model.stems = evident(stems.where((F.col("forms") >= 4) & (F.col("c") * 200 <= F.col("t"))))
    rows = featured(texts.select("text", "toxic"), model, "text").drop("text").toPandas()  # the bounded sample: a few numbers a row
    each.unpersist()
    seen.unpersist()
    x, y = rows[FEATURES].to_numpy(float), rows["toxic"].to_numpy(float)
    texts.unpersist()
    weight = np.where(y == 1, of[1] / max(1, y.sum()), of[0] / max(1, (1 - y).sum()))
    model.weights = [float(b) for b in fit(x, y, weight * len(y) / weight.sum())]
    return model


def featured(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The rows of df with FEATURES; columns of df with these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by Limits
    rows = df.drop(*FEATURES)
    at = rows.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        trie, memo = Trie(sent.value), {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = [features(t.as_py() or "", trie, memo) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.float64()) for c in zip(*x, strict=True))], [*batch.schema.names, *FEATURES])

    return rows.mapInArrow(tidied(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} double" for c in FEATURES]))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of df with FEATURES, score and predicted."""
    z = sum((b * F.col(c) for b, c in zip(model.weights[1:], FEATURES, strict=True)), F.lit(model.weights[0]))
    out = featured(df.drop("score", "predicted"), model, text_col).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id="doc_id"):
    """Whether a row is of the fold that is never learned from; not so without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def score_toxicity(df: DataFrame, labels: DataFrame, threshold: float = 0.3, limits: Limits = Limits(), learn_from: DataFrame | None = None) -> DataFrame:
    """Learns from the labels outside the held-out fold (and the texts of learn_from, else df), then scores every row of df."""
    texts = (learn_from or df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return score(df, learn(texts, marks, limits), "text", threshold)
