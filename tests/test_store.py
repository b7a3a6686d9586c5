"""Listings in pages, over a folder and over a service; transfers that move what is missing, all or nothing."""

import http.server
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import store

FILES = {"a/2023/x.txt": 3, "a/2023/y.txt": 5, "a/2024/x.txt": 7, "a/2024.txt": 2, "a-b/z.txt": 11, "b/deep/er/w.txt": 1, "top.txt": 4, "topmost/q.txt": 6}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "store"
    for key, size in FILES.items():
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text("x" * size)
    return str(root)


@pytest.fixture
def service():
    """A store that lists at most two objects a page."""
    asked = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            prefix, after, cut = q.get("prefix", ""), q.get("continuation-token", ""), q.get("delimiter")
            shown = {}
            for key in sorted(FILES):
                if key.startswith(prefix):
                    rest = key[len(prefix) :]
                    shown[prefix + rest.split(cut)[0] + cut if cut and cut in rest else key] = key
            names = [n for n in sorted(shown) if n > after]
            page = names[: min(2, int(q["max-keys"]))]
            body = "".join(f"<CommonPrefixes><Prefix>{n}</Prefix></CommonPrefixes>" if n.endswith("/") else f"<Contents><Key>{n}</Key><Size>{FILES[n]}</Size><LastModified>2024-01-01T00:00:00Z</LastModified><ETag>\"e{FILES[n]}\"</ETag></Contents>" for n in page)
            more = f"<NextContinuationToken>{page[-1]}</NextContinuationToken>" if len(names) > len(page) else ""
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f'<L xmlns="http://example.org/">{body}{more}</L>'.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/bucket", asked
    server.shutdown()


def sizes(df):
    rows = df.collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: r["size"] for r in rows}


@pytest.mark.parametrize("page", [1, 3, 1000])
def test_listing_of_a_folder(spark, folder, page):
    assert sizes(store.listed(spark, folder, page_size=page)) == FILES
    for prefix in ("a/", "a", "a/2024", "top", "b/deep/", "none/", "top.txt"):
        want = {k: v for k, v in FILES.items() if k.startswith(prefix)}
        assert sizes(store.listed(spark, folder, prefix, page)) == want, prefix
        assert sizes(store.listed(spark, folder, page_size=page).where(f"key like '{prefix}%'")) == want, prefix
    assert sizes(store.listed(spark, folder).where("key = 'a/2023/y.txt'")) == {"a/2023/y.txt": 5}
    assert sizes(store.listed(spark, "file://" + folder).where("size > 5 and key like 'a%'")) == {"a/2024/x.txt": 7, "a-b/z.txt": 11}


def test_listing_of_a_service(spark, service):
    root, asked = service
    assert sizes(store.listed(spark, root)) == FILES
    assert {r.etag for r in store.listed(spark, root, "b/").collect()} == {"e1"}
    asked.clear()
    assert sizes(store.listed(spark, root).where("key like 'a/%'")) == {k: v for k, v in FILES.items() if k.startswith("a/")}
    assert all(q.get("prefix", "").startswith("a/") for q in asked) and any("continuation-token" in q for q in asked)
    assert store.listed(spark, root).rdd.getNumPartitions() == 5  # four folders and what lies beside them


def test_transfers_move_what_is_missing_and_nothing_twice(spark, folder, tmp_path):
    target = tmp_path / "target"
    target.mkdir()
    here, there = (lambda: store.listed(spark, folder)), (lambda: store.listed(spark, str(target)))
    assert store.transfer(spark, here().where("key like 'a%'"), there(), folder, str(target), 8) == 5
    assert store.transfer(spark, here(), there(), folder, str(target), 8) == 3 and sizes(there()) == FILES
    assert store.transfer(spark, here(), there(), folder, str(target), 8) == 0
    (target / "top.txt").write_text("other size")
    assert store.transfer(spark, here(), there(), folder, str(target)) == 1 and (target / "top.txt").read_text() == "xxxx"


def test_an_aborted_transfer_leaves_nothing(spark, folder, tmp_path):
    target = tmp_path / "target"
    target.mkdir()
    wrong = store.listed(spark, folder).select("key", "size").unionByName(spark.createDataFrame([("gone.txt", 3)], "key string, size long"))
    with pytest.raises(PySparkException):
        store.transfer(spark, wrong, store.listed(spark, str(target)), folder, str(target), 4)
    assert list(target.iterdir()) == []


def test_packing_by_size(spark):
    files = spark.createDataFrame([(f"k{i}", 10) for i in range(1000)] + [("big", 5000), ("bigger", 9000)], "key string, size long")
    tasks = {}
    for r in store.packed(files, 1000).collect():
        tasks.setdefault(r.task, []).append(r["size"])
    assert sorted(map(sum, tasks.values()))[-2:] == [5000, 9000] and 10 <= len(tasks) - 2 <= 26
    assert all(sum(s) <= 1010 for t, s in tasks.items() if not t.startswith("file "))
