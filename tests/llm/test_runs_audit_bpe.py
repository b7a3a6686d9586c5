"""Runs of repetition, the audit of filters and byte pairs against brute force, on nulls, ties, repeats, empty and long texts."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import audit, bpe, periods, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(t):
    return (t or "").encode().split()


def tables(spark, folder, docs, labels=None):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def all_runs(x):
    """By the definition: each stretch that keeps a period, as far as it goes, with its smallest period."""
    n, out = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and x[k] == x[k + q]:
                k += 1
            if k + q - i >= max(6, 4 * q) and k > i:
                out.setdefault((i, k + q - i), q)
            i = k + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def texts_with_runs(n=260, seed=4):
    rnd = random.Random(seed)
    texts = []
    for i in range(n):
        few = rnd.choice([2, 3, 40])
        w = [rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:few]) + rnd.choice(["", "é"]) * (i % 3 == 0) for _ in range(rnd.choice([0, 1, 5, 6, 7, 60, 200]))]
        for _ in range(rnd.randint(0, 2)):
            if w:
                unit = [rnd.choice("xyz") for _ in range(rnd.randint(1, 9))]
                at = rnd.randrange(len(w))
                w[at:at] = unit * rnd.randint(3, 7)
        texts.append(rnd.choice(["", " ", "\n\t"]) + rnd.choice([" ", "  ", "\n", "\r\n"]).join(w))
    texts[:6] = [None, "", " \t\n", "a a a a a", "a a a a a a", "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb"]
    texts += [" ".join(str(i % 700) for i in range(30000)), "z " * 5000]
    return texts


def test_runs_equal_brute_force(spark, tmp_path):
    texts = texts_with_runs()
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "b b b b b b b", None, None, None), (7, texts[7], "en", "s", 0)]
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, tables(spark, tmp_path, docs)).collect() if r.doc_id is not None)
    want = []
    for id_, t, *_ in docs:
        if id_ is None:
            continue
        w, h = words(t), zlib.crc32(str(id_).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = [(0, n, 700)] if n == 30000 and w[700] == b"0" and h % 10 else all_runs(w)
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((id_, len(found), *shown, sha(b"".join(b"%d,%d,%d\n" % r for r in found)), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped))))
    assert got == sorted(want)
    none = [r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert [(r.n_runs, r.start, r.length, r.period) for r in none] == [(1, 0, 7, 1)]


def test_runs_of_number_sequences():
    rnd = random.Random(9)
    for _ in range(300):
        x = [rnd.randrange(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 60))]
        y = [x[i % rnd.choice([1, len(x)])] for i in range(rnd.randint(1, 60))]
        first, text = np.array(x + y), np.repeat([0, 1], [len(x), len(y)])
        s, n, q = periods.find_runs(first, text)
        assert list(zip(s, n, q)) == all_runs(x) + [(a + len(x), b, c) for a, b, c in all_runs(y)]


def test_runs_keep_other_columns_and_take_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a a a a a a", 9, "kept", None), (None, None, 8, None, 1.5)], "n_runs long, text string, period int, _w string, runs double")
    found = periods.periodic_runs(rows).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed, r._w) for r in found] == [(1, 0, 6, 1, 6000, "a", "kept"), (0, None, None, None, None, "", None)]
    assert periods.periodic_runs(rows.limit(0)).count() == 0


def audit_rows(docs, labels):
    """Each order run over the rows, filter by filter."""
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = {}
    for d, t, _, s, _ in docs:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        rows.setdefault(s or "", []).append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part, of in rows.items():
        removed, made = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = list(of)
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                removed[f] += len(gone)
                made.append(("".join(order), step, len(left), len(gone), sum(f in r[0] for r in of) - len(gone), sum(r[0] == {f} for r in of), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(part, *m, removed[m[0][m[1] - 1]]) for m in made]
    return sorted(out)


def audited():
    rnd = random.Random(6)
    docs = []
    for i in range(150):
        w = [rnd.choice(["one", "two", "Three", "F", "#", "é", "four", "x" + str(rnd.randrange(60))][rnd.randint(0, 5) :]) for _ in range(rnd.choice([0, 3, 49, 50, 51, 120]))]
        docs.append((i, " ".join(w), "en", rnd.choice(["a", "b", "hot", "hot", None, ""]), 0))
    hot = " ".join(f"w{i}" for i in range(60))
    docs += [(rnd.choice([None, 7, 200, 201 + i]), hot, "en", rnd.choice(["a", None, "hot"]), 0) for i in range(60)]
    docs += [(300, None, None, None, None), (301, "", None, "c", None), (301, "", None, "c", None), (None, "", None, "c", None), (302, "W " * 40000, None, "c", None)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_every_order_run(spark, tmp_path):
    docs, labels = audited()
    got = queries.op12_filter_audit(spark, tables(spark, tmp_path, docs, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == audit_rows(docs, labels)


def test_parity_sums_of_two_tables_add_up(spark):
    counts = spark.createDataFrame([("p", 1, 3, 5), ("p", 1, 3, 2), ("p", 0, 31, 4), ("q", 2, 0, 1)], "part string, label int, failed int, n long")
    parts = [audit.parity_sums(counts.where(c)) for c in ("n > 3", "n <= 3")]
    whole = sorted(tuple(r) for r in audit.audit(audit.parity_sums(counts)).collect())
    assert sorted(tuple(r) for r in audit.audit(parts[0].unionByName(parts[1])).collect()) == whole and len(whole) == 1200


def test_audit_of_clashing_columns_and_empty_tables(spark):
    docs, labels = audited()
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS key", "'x' AS failed", "2 AS n", "3 AS label", "4 AS part")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS source", "5 AS key", "6 AS n")
    run = lambda d, m: sorted(tuple(r) for r in audit.audit(audit.parity_sums(audit.failure_counts(d, m))).collect())
    assert run(d, m) == audit_rows(docs, labels)
    assert run(d, m.limit(0)) == audit_rows(docs, [])
    assert run(d.limit(0), m) == []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_pairs())


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.Vocabulary.load(queries.byte_pairs()))


def odd_texts(n, seed=5):
    rnd = random.Random(seed)
    parts = "' s t re ve ll d m don't 's 'll 'S a Z é 中 字 1 ² ½ ! <| endoftext |> <|endoftext|> 😀 the hello".split(" ") + [" ", "  ", "\n", "\t", "　", "\x85", "\xa0", "\x1c", "\x1f", "́", "\x00", "�"]
    parts += ["Ᲊ", "\U00010d41", "\U000e0100"]  # two of them letters and numbers since version 16.0
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    anything = lambda: chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF), rnd.randint(32, 126)]))
    return texts + ["".join(anything() for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " " * 3000, "", "\n" * 999 + "x", "é" * 999]


def ends(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))


def test_byte_pairs_equal_the_library(coder, library):
    texts = odd_texts(4000)
    ids, counts = coder.encode(*ends(texts))
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    upto = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == want
    assert [t.decode("utf-8", "replace") for t in coder.decode(ids, counts)] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_character_kinds_are_the_librarys():
    from tokenizers import pre_tokenizers

    split, kinds = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str, bpe.character_kinds()
    alone = lambda before, c: len(split(before + c)) == 1
    chosen = [cp for cp in range(0x110000) if cp % 37 == 0 or cp < 0x3100 or kinds[cp] != kinds[cp - 1]]
    for cp in chosen:
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            assert kinds[cp] == (bpe.LETTER if alone("a", c) else bpe.NUMBER if alone("1", c) else bpe.OTHER if alone("!", c) else bpe.SPACE), hex(cp)


def test_long_texts_in_pieces(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 500)
    for text in ("".join(odd_texts(600)[:600]), "中文字。\n字1 " * 2000, "word, Word's\n\n " * 2000):
        assert coder.encode_long(np.frombuffer(text.encode(), np.uint8)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_forced_boundaries_are_never_crossed(coder, library):
    """No token of the library's encoding lies across a forced cut, and short fragments merge alike one by one and together."""
    fragments = [t.encode() for t in ("hello", "aaaaaaa", "ababab", "theretherethe", "x")]
    assert [np.frombuffer(b, np.int32).tolist() for b in coder.merge_all(fragments)] == [coder.merge(f) for f in fragments]
    for text in odd_texts(300)[:600]:
        data = np.frombuffer(text.encode(), np.uint8)
        forced = set((np.flatnonzero(coder.forced[data[:-1].astype(np.uint16) * 256 + data[1:]]) + 1).tolist()) if len(data) else set()
        at = 0
        for i in library.encode(text, add_special_tokens=False).ids:
            size = int(coder.lengths[i])
            assert i in coder.special.values() or forced.isdisjoint(range(at + 1, at + size))
            at += size


def test_bpe_query_and_columns(spark, tmp_path, library):
    texts = [None, *odd_texts(200)]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, texts[3], "en", "s", 0)]
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bpe(spark, tables(spark, tmp_path, docs)).collect())
    want = []
    for i, t, *_ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want)
    rows = spark.createDataFrame([("a b", "mine", 1), (None, "x", 2), ("", None, None)], "text string, ids string, decoded int")
    path = queries.byte_pairs()
    coded = bpe.encode(rows, path)
    assert [(r.text, r.decoded, r.ids) for r in coded.collect()] == [("a b", 1, library.encode("a b").ids), (None, 2, None), ("", None, [])]
    assert [r.decoded for r in bpe.decode(coded, path).collect()] == ["a b", None, ""]
    assert bpe.encode(rows.limit(0), path, decoded="back").count() == 0
