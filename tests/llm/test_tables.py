"""Operators on vectors and pages, and the pipeline, against SQL and brute force, on small and on odd tables."""

import hashlib
import importlib
import math

import duckdb
import numpy as np
import pytest

from arbordoc.llm import archives, topk, vector_copies
from arbordoc.llm.common import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    base = rng.normal(size=(6, 8))
    for i in range(120):
        v = base[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 10 else None, "x", 1))
    rows += [(200, None, 1, "x", 1), (220, [0.0] * 8, 1, "x", 1), (240, [float("nan")] + [1.0] * 7, 1, "x", 1), (260, [1.0, None], 1, "x", 1), (280, [1.0, 2.0], 1, "x", 1), (300, [1.0, 2.0], 1, "x", 1), (320, [], 1, "x", 1), (340, [float("inf"), 1.0], 1, "x", 1), (None, [1.0, 2.0], 1, "x", 1)]
    rows += [(400 + i, rows[1][1], rows[1][2], "x", 1) for i in range(40)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, ids string, n int")


def test_top_k_sql(spark, duck):
    got = topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted((q, r, v, s) for q, r, v, s in duck.execute(topk.SQL).fetchall())


def test_top_k_odd(odd_vectors, monkeypatch):
    rows = [(r["vec_id"], [math.floor(64 * x) for x in r["embedding"]]) for r in odd_vectors.unionByName(odd_vectors.where("vec_id in (0, 20, 21, 400)")).collect() if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for b, (i, w) in enumerate(rows) if a != b)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])]
    repeated = odd_vectors.unionByName(odd_vectors.where("vec_id in (0, 20, 21, 400)"))
    for block, part, group in ((topk.BLOCK, topk.PART, topk.GROUP), (16, (48, 48), (4, 4))):
        for name, value in (("BLOCK", block), ("PART", part), ("GROUP", group)):
            monkeypatch.setattr(topk, name, value)
        got = topk.top_k(repeated).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(odd_vectors.limit(0)).count() == 0


def test_search_prunes_exactly():
    rng = np.random.default_rng(1)
    scale = np.exp(-np.arange(64) / 6)
    data, queries = (np.floor(rng.normal(size=(n, 64)) * scale * 40) for n in (3000, 70))
    ids, own = np.arange(3000) * 3, np.arange(70) * 3
    best = topk.Best(topk.Block(own, own, queries), 20)
    for at in range(0, 3000, 700):
        best.meet(topk.Block(ids[at : at + 700], ids[at : at + 700], data[at : at + 700]))
    for q, found, scores in zip(own.tolist(), best.ids, best.scores, strict=True):
        s = data @ queries[q // 3]
        order = [i for i in np.lexsort((ids, -s)).tolist() if ids[i] != q][:20]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()


def brute_links(rows, cosine):
    usable = {i: (g, np.array(v, float)) for i, v, g in rows if i is not None and v is not None and g is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    n, root = dict.fromkeys(usable, 0), {i: i for i in usable}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(usable)
    for a in keys:
        for b in keys:
            (g, x), (h, y) = usable[a], usable[b]
            if a < b and g == h and len(x) == len(y) and float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                n[a] += 1
                n[b] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {(i, n.get(i, 0), find(i) if i in usable else i, i is None or i not in usable or find(i) == i) for i, _, _ in rows}


def test_links_sql(spark, duck):
    got = vector_copies.link_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert {tuple(r) for r in got} == set(duck.execute("SELECT vec_id, n_links, component_id, kept FROM (" + vector_copies.SQL + ")").fetchall())


def test_links_odd(odd_vectors, monkeypatch):
    for name, n in (("BLOCK", 8), ("TILE", 4), ("BLOCKS", 1), ("CHILDREN", 2)):
        monkeypatch.setattr(vector_copies, name, n)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in odd_vectors.collect()]
    for cosine in (0.93, 0.5):
        got = vector_copies.link_vectors(odd_vectors, cosine).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == brute_links(rows, cosine)
    assert vector_copies.link_vectors(odd_vectors.limit(0)).count() == 0


def test_dense_block_memory():
    """A block in which all rows are linked keeps a forest, not the links."""
    rng = np.random.default_rng(3)
    n, x = 1024, rng.normal(size=8) + rng.normal(size=(1024, 8)) * 1e-3
    at = vector_copies.unit(x)[:, :2]
    row = {"ids": np.arange(n), "n": np.ones(n, np.int64), "labels": np.ones(n, np.int64), "sizes": np.full(n, 8), "coordinates": np.ascontiguousarray(at), "data": x}
    import tracemalloc

    tracemalloc.start()
    one = vector_copies.Block({k: v.tobytes() for k, v in row.items()})
    ids, links, edges = vector_copies.compare(one, None, 0.93, 0.38)
    assert set(links.tolist()) == {n - 1} and len(edges) == n - 1
    ids, links, edges = vector_copies.compare(one, vector_copies.Block({k: (v + n if k == "ids" else v).tobytes() for k, v in row.items()}), 0.93, 0.38)
    assert set(links.tolist()) == {n} and len(edges) == 2 * n - 1
    assert tracemalloc.get_traced_memory()[1] < 20e6


def test_interval_join_loses_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1, 2, 1]
    low = np.concatenate([np.sort(rng.integers(0, 3, 60))[:, None], x], axis=1)
    pairs = {(i, j) for a, b, c, d in vector_copies.join_intervals(low, low, 0.8, 4) for i in range(a, b) for j in range(c, d)}
    for i in range(60):
        for j in range(i, 60):
            if low[i, 0] == low[j, 0] and np.linalg.norm(x[i] - x[j]) <= 0.8:
                assert (i, j) in pairs or (j, i) in pairs


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    for one_task in (0, 10, 1000):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long"), one_task).collect()}
        assert got == {i: 0 for i in range(1, 61)} | {103: 100, 105: 100}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [archives.ArcRecord("http://a/x y\n", "1.2.3.4", "20230102030405", "text/html", b"HTTP/1.1 200 OK\r\nX-Record-Key: 7\r\n\r\nbody\n\n"), archives.ArcRecord("dns:a", "0.0.0.0", "20230102030405", "text/dns", b"")]
    data = archives.write_arc(records, version)
    back = list(archives.read_arc(data))
    assert [(r.url, r.ip, r.stamp, r.kind, r.content) for r in back] == [(r.url, r.ip, r.stamp, r.kind, r.content) for r in records]
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(archives.read_arc(data.replace(b"filedesc", b"other")))
    digest = hashlib.sha256(b"body\n\n").hexdigest()
    response, revisit = archives.convert(back[0], {}), archives.convert(back[0], {digest: "3"})
    assert b"WARC-Type: response" in response and b"WARC-Date: 2023-01-02T03:04:05Z" in response and response.endswith(b"body\n\n")
    assert b"WARC-Type: revisit" in revisit and archives.record_id("3").encode() in revisit and revisit.endswith(b"\r\n\r\n")
    assert b"WARC-Type: resource" in archives.convert(back[1], {})


def test_arc_files(spark, tmp_path):
    """Folders of ARC files, of both versions, gzipped in one or many members, damaged and empty, to WARC records."""
    import gzip

    page = lambda n: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"page\n\n%d " % n * 40
    records = [archives.ArcRecord(f"http://a/{n}", "1.2.3.4", "20230102030405", "text/html", page(n % 3)) for n in range(5)]
    for version in (1, 2):
        data = archives.write_arc(records, version)
        (tmp_path / f"v{version}.arc").write_bytes(data)
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(data[:70]) + gzip.compress(data[70:]))
    (tmp_path / "cut.arc").write_bytes(archives.write_arc(records, 1)[:-50])
    (tmp_path / "empty.arc").write_bytes(b"")
    (tmp_path / "bad.arc").write_bytes(b"what is this\n")
    arcs = archives.read_arcs(spark, str(tmp_path))
    rows = arcs.collect()
    assert sum(r["error"] is None for r in rows) == 4 * 5 + 4 and sorted(r["file"].rsplit("/", 1)[1] for r in rows if r["error"]) == ["bad.arc", "cut.arc"]
    assert {(r["url"], bytes(r["content"])) for r in rows if not r["error"]} == {(r.url, r.content) for r in records}
    archives.convert_arcs(arcs, f"{tmp_path}/out")
    found = [bytes(r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(found) == 24 and sum(b"WARC-Type: response" in x for x in found) == 3 and sum(b"WARC-Type: revisit" in x for x in found) == 21
    one = next(x for x in found if b"WARC-Type: response" in x)
    named = one[one.index(b"<urn:uuid:") :].split(b">")[0]
    assert sum(b"WARC-Refers-To: " + named in x for x in found) in (9, 8, 4)


def test_reader_goes_by_lengths():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n"
    stream = b"".join(archives.VERSION.encode() + f"WARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n" for _ in range(3))
    for step in (1, 7, 1000):
        reader = archives.WarcReader()
        found = [b for at in range(0, len(stream), step) for _, b in reader.feed(stream[at : at + step])]
        assert found == [block] * 3


def test_pages(spark, tmp_path):
    long = "<p>WARC/1.1\r\n\r\n" * 20
    rows = [(1, "http://a/ b", long, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", long, 1), (5, "ü", "é" * 60, 1), (6, "u", "é" * 60, 1), (7, "u", "short", 1), (8, "u", "short", 1), (9, "u", "x" * 300_000, 1), (None, "u", long, 1), (None, "n", "z" * 150, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives.write_warc(df, f"{tmp_path}/w", version=1)
    got = {None if r["key"] == "None" else int(r["key"]): (r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["html"]) for r in archives.read_warc(spark, f"{tmp_path}/w").collect()}
    first = {}
    for i, _, html, _ in rows[:9]:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        target = first.setdefault(digest, i) if len(data) >= 100 else i
        assert got[i] == ("response" if target == i else "revisit", len(data), digest, None if target == i else str(target), (html or "") if target == i else None)
    both = sorted((r["record_type"], str(r["refers_to"])) for r in archives.read_warc(spark, f"{tmp_path}/w").where("key = 'None'").collect())
    assert both == [("response", "None"), ("revisit", "1")]
    archives.write_warc(df.limit(0), f"{tmp_path}/none")
    assert archives.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    texts = [r["text"] for r in before.collect()]
    from arbordoc.llm import secret_scan

    assert not any(secret_scan.scan(t)[1] for t in texts)
    packed = pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert packed.agg({"length": "max"}).first()[0] <= 1024
    kept = {r["doc_id"] for r in before.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    distinct = docs.where(docs["doc_id"].isin(good)).dropDuplicates(["text"]).count()
    assert sum(i in kept for i in good) > 0.8 * distinct
