"""Operators on documents against brute force, on whole small tables and on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from arbordoc.llm import masked_lm, packing, quality, secret_scan, sentence_pieces, simhash, suffixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, bucket int, id int, fp int, _text string, _n int, _score int, task int, number int, `key` long, node long, block long, score double"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, repeated and long texts, clashing column names."""
    shared = "a passage of well over fifty bytes that several documents have in common: äöü! "
    texts = [(1, None), (2, ""), (3, "   "), (4, LONG), (5, LONG), (5, LONG), (6, shared + "with a tail of its own that is as long as the passage and a little longer than that"), (7, "head with many words which no other document of this little table has at all, " + shared), (8, shared * 3), (None, shared + LONG), (None, None), (9, "x" * 130_000), (10, "token=abcdef token%3Dabcdefgh1"), (11, LONG.replace("seven", "7")), (12, "日本語 " * 30), (13, "日本語 " * 31)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "p", 1, 2, 3, "t", 1, 2, 3, 4, 5, 6, 7, 0.5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same(a, b):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_secrets(request, which):
    df = request.getfixturevalue(which)
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    want = []
    for i, t in pairs(df):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, t, re.A) if ok(m))
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    found = secret_scan.find_secrets(df)
    from pyspark.sql import functions as F

    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind))
    same(found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(secret_scan.listed("base"), 256)).collect(), want)
    for r in found.collect():
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}


def test_redaction(spark, odd):
    rows = {r["doc_id"]: r["text"] for r in secret_scan.redact(odd).where("doc_id in (1, 4, 10)").collect()}
    assert rows == {1: None, 4: LONG, 10: "[SECRET] [SECRET]"}


def hidden(text):
    """The characters that spans beyond the text's own cover."""
    return {text[a:b] for a, _, b in secret_scan.scan(text)[1]}


SECRET = "password=hunter2hunter2"


def test_secrets_unreadable():
    import gzip
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        entry = tarfile.TarInfo("a.txt")
        entry.size = len(SECRET)
        tar.addfile(entry, io.BytesIO(SECRET.encode()))
    packed = [out.getvalue(), *(gzip.compress(x) for x in (b"\x1b[31m " + SECRET.encode(), ("é " + SECRET).encode("latin-1"), SECRET.encode("utf-16"), SECRET.encode("utf-16-be")))]
    for data in packed:
        run = base64.b64encode(data).decode()
        assert run in hidden(f"see {run} there")
    for data in (b"a\0 " + SECRET.encode() + b" b", b"\xff\xfe\x01\x02 " + SECRET.encode(), SECRET.encode("utf-16-le")):
        run = base64.b64encode(data).decode()
        assert hidden(f"see {run} there")


def test_secrets_members(monkeypatch):
    import bz2
    import gzip
    import lzma

    import zstandard

    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):
        run = base64.b64encode(pack(b"nothing here") + pack(SECRET.encode())).decode()
        assert run in hidden(f"see {run} there")
    monkeypatch.setattr(secret_scan, "LARGEST", 1 << 16)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    noise = np.random.default_rng(1).choice(list(b"abc xyz\n"), 3 << 20).astype(np.uint8).tobytes()
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: gzip.compress(gzip.compress(x))):
        run = base64.b64encode(pack(noise + b" " + SECRET.encode())).decode()
        assert run in hidden(f"see {run} there")
    monkeypatch.undo()
    for pack in (gzip.compress, zlib.compress):
        run = base64.b64encode(pack(SECRET.encode() + b" " + noise)[:-3000]).decode()
        assert run in hidden(f"see {run} there") and secret_scan.scan(run)[3] == 1


def test_secrets_wrapped():
    import gzip

    noise = " ".join(map(str, np.random.default_rng(1).integers(0, 1 << 40, 40))).encode()
    data = gzip.compress(noise + SECRET.encode())
    for width in (64, 76):
        for end in ("\n", "\r\n", "\\n", "\n    "):
            code = base64.b64encode(data).decode()
            lines = end.join(code[i : i + width] for i in range(0, len(code), width))
            assert lines in hidden(f"see\n{lines}\n")
            code = base64.b64encode(b"x" * (width * 3 // 4 - 12) + b" " + SECRET.encode() + b" and more of this").decode()
            lines = end.join(code[i : i + width] for i in range(0, len(code), width))
            assert any(end in x and x.replace(end, "") in code for x in hidden(f"see\n{lines}\n"))


def _encoders():
    """name -> (encode, whether spans map to single characters)."""
    import bz2
    import gzip
    import io
    import lzma
    import zipfile

    import zstandard

    code = lambda data: base64.b64encode(data).decode()

    def deflated(x):
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(x) + c.flush()

    def archived(x):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("notes.txt", x)
        return out.getvalue()

    each = {"percent": lambda c: f"%{ord(c):02X}", "unicode": lambda c: f"\\u{ord(c):04x}", "bytes": lambda c: f"\\x{ord(c):02x}", "reference": lambda c: f"&#x{ord(c):x};", "decimal": lambda c: f"&#{ord(c)};"}
    found = {k: ((lambda t, f=f: "".join(map(f, t))), f) for k, f in each.items()}
    found["base64"] = (lambda t: code(t.encode()), None)
    found["wide"] = (lambda t: code(t.encode("utf-16-le")), None)
    for name, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bz2", bz2.compress), ("xz", lzma.compress), ("zstd", zstandard.compress), ("deflate", deflated), ("zip", archived)):
        found[name] = (lambda t, pack=pack: code(pack(t.encode())), None)
    return found


ENCODERS = _encoders()


@pytest.mark.parametrize("outer", ENCODERS)
@pytest.mark.parametrize("inner", ENCODERS)
def test_secrets_nested(inner, outer):
    """Each pair of encodings: the secret is found, and its span covers its own signs, or the run that holds it."""
    plain = "see also " + SECRET + " and more words"
    once, each = ENCODERS[inner]
    again, every = ENCODERS[outer]
    text = "before " + again(once(plain)) + " after"
    spans = {(a, b) for a, _, b in secret_scan.scan(text)[1]}
    start, end = 7, 7 + len(again(once(plain)))
    assert any(start <= a < b <= end for a, b in spans)
    if each and every:  # every sign maps to its own signs in the text
        at = 7 + len(again(once("see also ")))
        assert (at, at + len(again(once(SECRET)))) in spans
    elif every is None and outer not in ("base64", "wide"):
        assert (start, end) in spans
    elif each is None and inner not in ("base64", "wide"):  # escapes around packed data: the run as a whole
        assert any(b - a >= (end - start) * 0.9 for a, b in spans)


def test_secrets_odd_layers():
    import gzip
    import time

    bomb = gzip.compress(gzip.compress(b"nothing"))
    assert secret_scan.scan("x " + base64.b64encode(bomb).decode())[1] == set()
    for text in ("%70%61%73%73%77%6F%72%64%3D%73%65%63%72%65%74%31%32%FF", "password%3D%FFabcdefgh", "password%3Dabcdefgh%FF"):
        assert hidden(text), text
    assert hidden("token%3Dabc%2541defgh") == {"token%3Dabc%2541defgh"}
    for one, more, last in (("%", "25", "3D"), ("\\", "u005c", "u003d"), ("&", "#38;", "#61;")):
        text = "password" + one + more * 30_000 + last + "abcdefgh"
        began = time.time()
        assert text in hidden(text)
        assert time.time() - began < 5


def test_secrets_cycle(monkeypatch):
    """A layer that unpacks to itself is not taken up again."""
    data = b"\x1f\x8b looped"
    monkeypatch.setattr(secret_scan, "Unpacking", type("Loop", (), {"damaged": False, "refused": False, "__init__": lambda self, d: None, "__iter__": lambda self: iter([data])}))
    run = base64.b64encode(data * 2).decode()
    assert secret_scan.scan("see " + run)[1] == set()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for capacity in (64, 1024):
        want = []
        for i, t in pairs(df):
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
            at, size = 0, len(ids) % capacity or capacity
            while at < len(ids):
                want.append((i, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
                at, size = at + size, capacity
        rows = packing.pack_documents(df, path, capacity).collect()
        same([(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows], want)
        places = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for x in places.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= capacity
        bins = []  # plain best-fit decreasing
        for n in sorted((w[2] for w in want), reverse=True):
            fit = [b for b in range(len(bins)) if bins[b] >= n]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= n
            else:
                bins.append(capacity - n)
        assert len(places) == len(bins)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sentence_pieces(request, which):
    from sentencepiece import SentencePieceProcessor

    df = request.getfixturevalue(which)
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for i, t in pairs(df) for ids in [[*sp.encode(t), sp.eos_id()]]]
    same(sentence_pieces.encode_digests(df, path).collect(), want)
    same([(r["doc_id"], len(r["ids"]), sha(" ".join(map(str, r["ids"]))), sha(r["decoded"])) for r in sentence_pieces.encode_documents(df, path).collect()], want)


def simhash_of(text, n, seed=42):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), seed) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows, linked):
    """row -> the least id it reaches."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if a < b and linked(x, y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in root}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, simhash_of(t, 4)) for i, t in pairs(df)]
    group = grouped([r for r in rows if r[0] is not None], lambda x, y: (x ^ y).bit_count() <= 4)
    of_print = {x: group[i] for i, x in rows if i is not None}
    found = simhash.components(simhash.fingerprint_documents(df), 4, 3)
    same([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found.collect()], [(i, x, of_print.get(x)) for i, x in rows])


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
def test_simhash_links_all(spark, hot):
    """Loose and dense groups, through small, large and twice-joined groups of variants."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    base = np.concatenate([base, base[:3] ^ np.uint64(0b111 << 40), base[:1] & np.uint64(0x3FFFFF) | np.uint64(5 << 50)])
    fp = np.repeat(base, 90)
    for row in range(len(fp)):
        for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
            fp[row] ^= np.uint64(1 << b)
    loose = base[0] & np.uint64(0x1FFFFF) | rng.integers(0, 1 << 40, 300, dtype=np.uint64) << np.uint64(23)
    fp = np.unique(np.concatenate([fp, loose]))
    rows = list(enumerate(fp.tolist()))
    want = grouped(rows, lambda x, y: (x ^ y).bit_count() <= 4)
    df = spark.createDataFrame([(i, int(np.int64(np.uint64(x)))) for i, x in rows], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(df, 4, 3, hot=hot).collect()}
    assert got == want and len(set(want.values())) > 5


@pytest.mark.parametrize("large", [simhash.LARGE, 40])
def test_simhash_large_groups(monkeypatch, large):
    """A variant that hundreds share, most of them unrelated: joined once more by the other bits, nothing is lost."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(9)
    cuts = simhash.segments_of(64, 3)
    first, n = cuts[1]
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.concatenate([fp, fp[:200] ^ (np.uint64(1) << rng.integers(0, 20, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(45, 64, 200).astype(np.uint64))])
    mask = np.uint64(((1 << n) - 1) << first)
    fp = np.unique(fp & ~mask | np.uint64(5 << first))
    ids, keys = np.arange(len(fp)), np.full(len(fp), 1 << 50)
    got = simhash.stars(np.concatenate(simhash.links(keys, ids, fp, 4, cuts)))
    want = grouped(list(enumerate(fp.tolist())), lambda x, y: (x ^ y).bit_count() <= 4)
    assert {b: a for a, b in got.tolist()} == {i: c for i, c in want.items() if i != c}


def test_keep_one(odd, docs):
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert set(kept) >= {1, 4, 6, 7, 9, 10, 12, None} and not {2, 3, 5} & set(kept)
    texts = {i: t for i, t in pairs(docs)}
    stay = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {texts[i] for i in stay} <= set(texts.values())
    assert len(stay) == len({texts[i] for i in stay})


def test_simhash_segments(docs):
    with pytest.raises(ValueError, match="segments"):
        simhash.components(docs, 8, 4)


def test_keep_one_exact(spark):
    """Groups by exact Jaccard similarity of five-word shingles, with pairs just above and below 0.8."""
    rng = np.random.default_rng(5)
    texts = []
    for group in range(60):
        words = [f"w{group}x{i}" for i in range(204)]
        texts.append(" ".join(words))
        for changed in (3, 4, 5, 6, 8):  # 0.86, 0.82, 0.78, 0.74, 0.67
            other = list(words)
            for at in rng.choice(40, changed, replace=False).tolist():
                other[at * 5 + 2] += "y"
            texts.append(" ".join(other))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a // 6 * 6, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]))[::-1]
                root = [new if r == old else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(root)


def test_keep_one_simhash(spark, monkeypatch):
    """Without bands, fingerprints lead to the near copies within their limit, and exact similarity decides."""
    rng = np.random.default_rng(9)
    texts = []
    for group in range(20):
        words = [f"w{group}x{i}" for i in range(600)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(rng.permutation(words))]
    prints = [simhash.print_of(simhash.shingle_set(t, 5)) % (1 << 64) for t in texts]
    near = {i for i in range(1, 60, 3) if (prints[i] ^ prints[i - 1]).bit_count() <= simhash.LIMIT}
    assert len(near) > 15
    monkeypatch.setattr(simhash, "bands_of", lambda x: np.zeros(0, np.int64))
    # fingerprints that all agree: exact similarity still parts what is not alike
    for same_print in (False, True):
        if same_print:
            monkeypatch.setattr(simhash, "print_of", lambda x: 5)
            near = set(range(1, 60, 3))
        for most in (1024, 16):
            found = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.8, 5, most=most).collect()
            assert {r["doc_id"] for r in found if r["component_id"] != r["doc_id"]} == near


def test_keep_one_slices(spark):
    """Bands larger than a task may hold: copies of one text, and chains that only far slices connect."""
    rng = np.random.default_rng(6)
    texts = []
    for group in range(3):
        words = [f"w{group}x{i}" for i in range(120)]
        for i in range(70):
            other = list(words)
            for at in rng.choice(24, (0, 2, 5)[group] if i else 0, replace=False).tolist():
                other[at * 5 + 2] += f"y{i % 40}"
            texts.append(" ".join([*other, f"tail{i}"]))
    sets = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in enumerate(texts)]
    want = grouped(sets, lambda x, y: len(x & y) >= 0.8 * len(x | y))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1024, 16):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, 0.8, 5, most=most).collect()} == want
    assert len(set(want.values())) > 3


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_suffixes(request, monkeypatch, which, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    df = request.getfixturevalue(which)
    for length in (20, 50):
        rows = [(i, t.encode()) for i, t in pairs(df)]
        first = {}
        for i, t in rows:
            for at in range(len(t) - length + 1):
                s = t[at : at + length]
                first[s] = min(first.get(s, 1 << 63), 1 << 63 if i is None else i)
        want = []
        for i, t in rows:
            gone = bytearray(len(t))
            for at in range(len(t) - length + 1):
                if first[t[at : at + length]] < (1 << 63 if i is None else i):
                    gone[at : at + length] = b"\1" * length
            kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
            want.append((i, len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
        same(suffixes.report(df, length).collect(), want)
    out = suffixes.without_repeats(df)
    assert out.schema == df.schema and out.count() == df.count()


def test_suffixes_messages(spark, monkeypatch):
    """What chunks send each other follows from the contexts, not from the text's length: else rows grow with its square."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").repartition(4)
    usual, sent, saved = suffixes.report(docs).collect(), {}, suffixes.saved

    def counted(df, name, **options):
        out = saved(df, name, **options)
        sent[name] = out
        return out

    monkeypatch.setattr(suffixes, "saved", counted)
    monkeypatch.setattr(suffixes, "BUCKET", 1 << 14)  # as a text 2,000 times as long would have them
    same(suffixes.report(docs).collect(), usual)
    chunks = sent["contexts"].select("chunk").distinct().count()
    assert sent["contexts"].where("bucket >= 0").count() <= 9 * chunks
    for contexts, deal in ((64, 1), (256, 8)):
        monkeypatch.setattr(suffixes, "CONTEXTS", contexts, raising=False)
        monkeypatch.setattr(suffixes, "DEAL", deal, raising=False)
        same(suffixes.report(docs).collect(), usual)
        assert sent["contexts"].where("bucket >= 0").count() > 9 * chunks


def test_quality(spark, odd):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score_documents(docs, labels).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in test)
    print("held-out accuracy", right / len(test))
    assert right / len(test) > 0.95
    scored = quality.score_documents(odd, labels.limit(0)).collect()
    assert len(scored) == odd.count() and {r["score"] for r in scored} == {0.5}
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(odd, labels).collect())
    known = spark.createDataFrame([(i, i % 2, 0) for i in (2, 4, 5, 6, 7, 8, 9)], labels.schema)
    model = quality.fit(odd, known)
    scores = {(r["doc_id"], r["score"]) for r in quality.score_documents(odd, known).collect()}
    kept = quality.keep_good(odd, model)
    assert kept.schema == odd.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in quality.score_documents(odd, known).where("score >= 0.5").collect())
    assert len({i for i, _ in scores}) == len({r["doc_id"] for r in odd.collect()})


def test_quality_brute_force(spark, docs):
    """Scores and the pipeline's choice against all pairs of features, one by one."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    want = {}
    rows = [(r["doc_id"], r["text"] or "", r["n_chars"]) for r in docs.collect() if len(r["text"] or "") < 1500][:40]
    for i, t, n in rows:
        index, value = quality.Features().of(t, n)
        x = value.astype(float).copy()
        x[-quality.STRUCTURE :] = np.clip((x[-quality.STRUCTURE :] - model.mean) / model.scale, -4, 4) / 4
        margin = model.bias + sum(float(model.linear[k]) * v for k, v in zip(index.tolist(), x.tolist(), strict=True))
        for a in range(len(x)):
            for b in range(a):
                margin += float(model.factors[index[a]] @ model.factors[index[b]]) * x[a] * x[b]
        want[i] = 1 / (1 + np.exp(-margin))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert all(abs(got[i] - s) < 1e-3 for i, s in want.items())
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).collect()}
    assert all((i in kept) == (s >= 0.5) for i, s in want.items() if abs(s - 0.5) > 1e-3)


def test_stages_on_odd_rows(odd):
    """Every stage on nulls, empty, repeated and long texts, clashing names, and on an empty table: all columns, no crash."""
    import importlib

    pipeline = importlib.import_module("corpus_pipeline")
    for df in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(df.sparkSession, df, SF)
            assert out.columns == df.columns and out.dtypes == df.dtypes, name
            assert out.count() <= df.count()
        packed = pipeline.STAGES[-1][1](df.sparkSession, df, SF)
        assert (packed.select("doc_id", "piece").count() >= df.count()) and (df.count() or not packed.count())


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    model = quality.untrained()
    model.factors[:] = rng.normal(size=model.factors.shape)
    index, x = np.array([3, 9, 50, 70], np.int32), rng.normal(size=4).astype(np.float32)
    v = model.factors[index]
    plain = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(model.margin(index, x) - plain) < 1e-3


def lm(df, rounds=1):
    dealt = masked_lm.blocks(df)
    answers = masked_lm.count(dealt)
    vocabulary = masked_lm.vocabulary_of(answers)
    return dealt, answers, vocabulary, masked_lm.train(dealt, vocabulary, rounds)


def test_masked_lm(spark, odd, docs):
    dealt, answers, vocabulary, flat = lm(docs, 2)
    words = Counter(w for _, t in pairs(docs) for w in t.split())
    hashes = {w: xxhash.xxh64_intdigest(w) for w in words}
    top = sorted(words, key=lambda w: (-words[w], hashes[w]))[: masked_lm.KNOWN]
    assert vocabulary.of(np.array([hashes[w] for w in top], np.uint64)).tolist() == list(range(len(top)))
    rest = Counter(hashes[w] % masked_lm.OTHERS for w in words.keys() - set(top))
    assert vocabulary.sums[1].astype(int).tolist() == [rest[b] for b in range(masked_lm.OTHERS)] and vocabulary.sums[0].sum() == sum(words.values()) - sum(words[w] for w in top)
    real = {r["doc_id"]: r for r in masked_lm.score(dealt, answers, vocabulary, flat).collect()}
    rng = np.random.default_rng(2)
    shuffled = masked_lm.blocks(spark.createDataFrame([(i, " ".join(rng.permutation(t.split()))) for i, t in pairs(docs)], "doc_id long, text string"))
    mixed = {r["doc_id"]: r for r in masked_lm.score(shuffled, masked_lm.count(shuffled), vocabulary, flat).collect()}
    assert sum(r["log_probability"] for r in real.values()) > sum(r["log_probability"] for r in mixed.values())
    start = {r["doc_id"]: r for r in masked_lm.score(dealt, answers, vocabulary, masked_lm.Network.start().flat).collect()}
    assert sum(r["log_probability"] for r in real.values()) > sum(r["log_probability"] for r in start.values())
    assert all(real[i]["n_words"] == len(t.split()) for i, t in pairs(docs))
    rows = masked_lm.score_corpus(odd).collect()
    assert len(rows) == odd.count() and all((r["n_words"] == 0) == (r["mean_log_probability"] is None) for r in rows)


def test_masked_lm_layout(docs, monkeypatch):
    """The same scores however the table is cut, through many blocks and ranges."""
    monkeypatch.setattr(masked_lm, "BLOCK", 1 << 16)
    monkeypatch.setattr(masked_lm, "RANGE", 1 << 16)
    one, two = ({r["doc_id"]: r["log_probability"] for r in masked_lm.score_corpus(df).collect()} for df in (docs.repartition(1), docs.orderBy("text").repartition(7)))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) <= 1e-6 * abs(one[i]) for i in one)


def test_masked_lm_sums_to_one():
    """The probabilities of all words at one place add up to one."""
    rng = np.random.default_rng(8)
    n = rng.integers(1, 50, 3000)
    hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    order = np.argsort(-n, kind="stable")[: masked_lm.KNOWN]
    bucket = (hashes % np.uint64(masked_lm.OTHERS)).astype(int)
    v = masked_lm.Vocabulary([(int(hashes[i]), int(n[i])) for i in order], np.stack([np.bincount(bucket, n, masked_lm.OTHERS), np.bincount(bucket, minlength=masked_lm.OTHERS)]))
    number = v.of(hashes)
    net = masked_lm.Network(masked_lm.Network.start().flat * 20)
    around = np.tile(np.array([[3, 900, 5, masked_lm.EDGE]], np.int16), (3000, 1))
    p = np.exp(net.log_probability(around, number))
    whole = sum(float(np.exp(net.log_probability(around[:1], np.array([k], np.int16)))[0]) for k in range(masked_lm.EDGE))
    left_out = v.sums[0] - 1 + masked_lm.HALF * v.sums[1]  # the occurrence that is scored is left out of its bucket
    share = np.where(number < masked_lm.KNOWN, 1.0, (n + masked_lm.HALF) / (left_out + 1)[np.maximum(number.astype(int) - masked_lm.KNOWN, 0)])
    empty = [k for k in range(masked_lm.EDGE) if k not in set(number.tolist())]
    unused = sum(float(np.exp(net.log_probability(around[:1], np.array([k], np.int16)))[0]) for k in empty)
    assert abs(whole - 1) < 1e-4 and abs(float((p * share).sum()) + unused - 1) < 1e-4


def test_masked_lm_steps():
    """The parts that make training and scoring cheaper give what their plain forms give."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 5, (50, masked_lm.BASE)), rng.normal(0, 3000, (50, masked_lm.BASE))])
    e, total = masked_lm._exponentials(x.copy())
    want = np.exp(x - x.max(1, keepdims=True))
    assert np.allclose(e, want, rtol=1e-12) and np.allclose(total, want.sum(1), rtol=1e-12)
    keys, rows = rng.integers(0, 40, 300).astype(np.int16), rng.normal(0, 1, (300, 5))
    used, sums = masked_lm._added(keys, rows)
    assert used.tolist() == sorted(set(keys.tolist())) and np.allclose(sums, [rows[keys == k].sum(0) for k in used])
    texts = ["a b a", "", "  ", "\u00e4\u2003b \x00 a"]
    words = masked_lm.Words.of(texts)
    assert words.keys[words.word].tolist() == [xxhash.xxh64_intdigest(w) for t in texts for w in t.split()]


def test_masked_lm_words(spark):
    """Words of one bucket are told apart, as targets and as neighbours, by counts of the whole corpus."""
    common = [f"c{i}" for i in range(masked_lm.KNOWN)]
    bucket = lambda w: xxhash.xxh64_intdigest(w) % masked_lm.OTHERS
    rare = [w for w in (f"r{i}" for i in range(40_000)) if bucket(w) == 7][:6]
    texts = [" ".join(common)] * 30 + [f"c1 {rare[0]} {rare[1]} c2"] * 20 + [f"c1 {rare[2]} {rare[3]} c2", f"c1 {rare[0]} {rare[3]} c2", f"c1 {rare[4]}", "", rare[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    dealt, answers, vocabulary, flat = lm(df)
    got = {r["doc_id"]: r["log_probability"] for r in masked_lm.score(dealt, answers, vocabulary, flat).collect()}
    split = [t.split() for t in texts]
    n, pairs = Counter(w for x in split for w in x), Counter(p for x in split for p in zip(x, x[1:], strict=False))
    before, behind = Counter(w for x in split for w in x[:-1]), Counter(w for x in split for w in x[1:])
    net = masked_lm.Network(flat)
    number_of = {w: int(vocabulary.of(np.array([xxhash.xxh64_intdigest(w)], np.uint64))[0]) for w in n}
    shared = [w for w in n if number_of[w] >= masked_lm.KNOWN]
    assert sorted(shared) == sorted(rare)
    for i, x in enumerate(split):
        numbers = [masked_lm.EDGE] * 2 + [number_of[w] for w in x] + [masked_lm.EDGE] * 2
        want = 0.0
        for k, w in enumerate(x):
            around = np.array([[numbers[k], numbers[k + 1], numbers[k + 3], numbers[k + 4]]])
            q = float(np.exp(net.log_probability(around, np.array([number_of[w]]))[0]))
            if w in shared:
                q *= (n[w] - 0.5) / (sum(n[v] for v in shared) - 1 + len(shared) / 2)
            sides = []
            for there, seen, pair in ((k > 0, before[x[k - 1]], (x[k - 1], w)), (k + 1 < len(x), behind[x[min(k + 1, len(x) - 1)]], (w, x[min(k + 1, len(x) - 1)]))):
                a = max(1.0, (seen - 1) ** 0.75) if there else 0
                sides.append((pairs[pair] - 1 + a * q) / (seen - 1 + a) if there else q)
            want += float(np.log(sum(sides) / 2))
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))
    assert got[30] > got[51] + 2 > got[50] + 2  # one bucket: known pair, known word beside a new one, two new words


def test_gradient():
    rng = np.random.default_rng(4)
    around, word = rng.integers(0, masked_lm.EDGE + 1, (8, 4)), rng.integers(0, masked_lm.EDGE, 8)
    net = masked_lm.Network(masked_lm.Network.start().flat.astype(np.float64))
    sums = masked_lm.Network(np.zeros(masked_lm.SIZE))
    old = net.flat.copy()
    net.step(around, word, sums)
    g = np.sqrt(sums.flat)
    for at in (int(np.argmax(g)), masked_lm.SIZE - 5 if g[-5] else int(np.argmax(g))):
        value = []
        for d in (-1e-5, 1e-5):
            moved = old.copy()
            moved[at] += d
            value.append(-masked_lm.Network(moved).log_probability(around, word).mean())
        assert abs(abs(value[1] - value[0]) / 2e-5 - g[at]) < 1e-5


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = public_tokenizers.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (secret_scan.find_secrets(none), secret_scan.redact(none), packing.pack_documents(none, path), sentence_pieces.encode_digests(none, model), simhash.keep_one(none), simhash.components(simhash.fingerprint_documents(none), 4, 3), suffixes.report(none), suffixes.without_repeats(none), quality.score_documents(none, labels), masked_lm.score_corpus(none)):
        assert df.count() == 0
