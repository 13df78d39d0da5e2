"""Each registered query against a brute-force version, on the sf0.001 tables,
on a table of odd rows and on empty tables."""
import hashlib
import itertools
import os
import random
import tempfile
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import types as T

from gridlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # extra columns whose names clash with the operators' own
                     T.StructField("ids", T.StringType()), T.StructField("fp", T.StringType()),
                     T.StructField("line", T.StringType()), T.StructField("shard", T.LongType())])
ITEMS = "item_id long, text string, doc string"
PAGES = "page_id long, url string, html string, host string, word string"


def _prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_docs():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    base = "\n".join(_prose(rng, 40, vocab) for _ in range(4))
    near = base.replace(" ", " zz ", 1)
    texts = [None, "", " ", "\n\n", "12 34", "\u00e9t\u00e9 \u6f22\u5b57 \u03a9", base, base, near, base.upper(), "x" * 5000,
             "the " * 3000, "a b c d e f g h i j k l", "Hello world", "Hello world", "hello  world\t\u00a0end \n",
             "<|endoftext|> stays text", "\U0001f642\U0001f642 ok\x1cno\u0085yes", _prose(rng, 20000, vocab),
             _prose(rng, 300, vocab) + " " + _prose(random.Random(3), 12, vocab), "don't we'll it's  2024"]
    texts += [_prose(rng, rng.randint(1, 90), vocab) for _ in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], "s", None, "x", "y", "z", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base, "en", None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def _dir(spark, docs, items, pages, labels=()):
    d = tempfile.mkdtemp(prefix="gridlens-llm-", dir="/tmp")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(pages, PAGES).coalesce(2).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, part string").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_docs()
    text = rows[19][1].split(" ")
    items = [(1, " ".join(text[300:312]), "d"), (2, "Hello, WORLD!", None), (3, None, None), (4, "", None), (5, "...", None),
             (6, " ".join(text[300:312]), None), (None, " ".join(text[5:20]), None), (11, "nowhere to be found", None)]
    pages = [(1, "https://Blog.cheappills.example.net/en/5?x=1#y", "<p>blog of shops</p>", "h", "w"),
             (2, None, None, None, None), (3, "no scheme", "", None, None), (4, "http://example.org/es/1", "the the", None, None),
             (5, "http://sub.example.org/es", "es", None, None), (6, "http://notexample.org/es/", "x", None, None),
             (7, "ftp://a.com/fr/x", None, None, None), (8, "ftp://a.com?q=/fr/", None, None, None),
             (9, "http://example.org/en/12", None, None, None), (9, "http://example.org/en/12", None, None, None),
             (10, "http://" + "z" * 3000 + ".net/" + "q" * 9000, "q", None, None), (11, "a://b://c.org/", None, None, None),
             (12, "http://org/", None, None, None), (13, "", "", None, None), (None, "x://org", None, None, None)]
    labels = [(i, i % 2, i % 3 % 2, "p") for i in range(0, 60, 2)] + [(6, 1, 0, None), (6, 0, 1, None), (None, 1, 1, None), (7, None, None, None)]
    return _dir(spark, rows, items, pages, labels)


@pytest.fixture(scope="module")
def empty(spark):
    return _dir(spark, [], [], [])


def read(d, name):
    return pd.read_parquet(f"{d}/{name}.parquet").to_dict("records")


def clean(v):
    return None if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA else v


def docs_of(d):
    return [(None if clean(r["doc_id"]) is None else int(r["doc_id"]), clean(r["text"]), clean(r["lang"])) for r in read(d, "documents")]


def run(spark, name, d):
    return [r.asDict() for r in Q.QUERIES[name](spark, d).collect()]


def keyed(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert run(spark, name, empty) == []


@pytest.fixture(params=["sf", "odd"])
def where(request, odd):
    return SF if request.param == "sf" else odd


def test_op1(spark, where):
    import base64

    import tiktoken
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in docs_of(where):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha((t or "").encode())))
    assert keyed(run(spark, "op1_bpe", where), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_op2(spark, where):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = [(clean(r["item_id"]), split(clean(r["text"]))) for r in read(where, "benchmark")]
    windows = [(i, w[k:k + 10]) for i, w in windows if w for k in range(max(1, len(w) - 9))]
    want = []
    for i, t, _ in docs_of(where):
        w = split(t)
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        hit, items = set(), set()
        for item, q in windows:
            for k in at.get(q[0], ()):
                if w[k:k + len(q)] == q:
                    hit.update(range(k, k + len(q)))
                    if item is not None:
                        items.add(str(int(item)))
        want.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit)))
    got = run(spark, "op2_decontamination", where)
    assert keyed(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert sum(w[5] for w in want) >= 2


def _own_keys(docs):
    """(id or number, tag) of each row, as the operator's docstring states."""
    many = Counter(d[0] for d in docs)
    shared = sorted((k for k, d in enumerate(docs) if d[0] is None or many[d[0]] > 1),
                    key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, docs[k][1] is not None, hashlib.md5((docs[k][1] or "").encode()).hexdigest()))
    keys, start = {k: (d[0], 0) for k, d in enumerate(docs)}, {}
    for n, k in enumerate(shared):
        i = docs[k][0]
        keys[k] = (n, 1 << 23) if i is None else (i, n - start.setdefault(i, n) + 1)
    return keys


def _repeats(docs):
    firsts, out = {}, []
    keys = _own_keys(docs)
    for k in sorted(keys, key=keys.get):
        raw = (docs[k][1] or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for x in range(len(raw) - 99):
            if firsts.setdefault(raw[x:x + 100], (k, x)) != (k, x):
                cover[x] += 1
                cover[x + 100] -= 1
        hit = np.cumsum(cover[:-1]) > 0
        spans = int(hit[:1].sum()) + int((hit[1:] & ~hit[:-1]).sum())
        out.append((docs[k][0], len(raw), int(hit.sum()), spans, sha(bytes(np.frombuffer(raw, np.uint8)[~hit]))))
    return out


def test_op3(spark, where):
    want = _repeats(docs_of(where))
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    a, b = keyed(run(spark, "op3_repeats", where), *cols), sorted(want, key=repr)
    assert [x for x in a if x not in b][:3] == [x for x in b if x not in a][:3] == []
    assert len(a) == len(b) and sum(r[2] for r in want) > 0


def test_op3_rows_that_share_ids_or_have_none(spark):
    """Thousands of texts without an id, and texts that share one: no row takes another's spans."""
    from gridlens.llm import suffix
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    common = [text(130) for _ in range(20)]
    docs = [(None, text(120), None) for _ in range(3000)]
    docs += [(None, text(30) + rng.choice(common) + text(30), None) for _ in range(300)]
    docs += [(k % 7, text(20) + rng.choice(common), None) for k in range(150)] + [(1000 + k, common[k], None) for k in range(5)]
    docs += [docs[3005]] * 3 + [docs[3310]] * 2 + [(-(1 << 63), common[6], None), (None, None, None), (None, "", None)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(5)
    got = [(r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, sha(bytes(r["kept"]))) for r in
           suffix.remove_repeats(frame, "doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(_repeats(docs), key=repr)


def test_op4(spark, where):
    docs = {i: (t, y) for i, t, y in docs_of(where)}
    got = run(spark, "op4_language", where)
    assert len(got) == len(docs_of(where))
    langs = {y for _, y in docs.values() if y}
    right = n = 0
    for r in got:
        i = r["doc_id"]
        if i is None:  # two rows share it
            continue
        t, y = docs[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if not t or not regex.search(r"\p{L}", t):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in langs and 0 <= r["score"] <= 1
        if r["held_out"] and y and r["lang_pred"] != "und":
            n, right = n + 1, right + (r["lang_pred"] == y)
    if where == SF:
        assert right >= 0.95 * n and n > 20


def _fingerprint(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(docs):
    fps = [_fingerprint(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _, _) in enumerate(docs)], [find(k) for k in range(len(docs))]


def test_op5(spark, where):
    want, _ = _components(docs_of(where))
    assert keyed(run(spark, "op5_simhash", where), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_op6(spark, where):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, seen = [], Counter()
    for i, t, _ in docs_of(where):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = run(spark, "op6_token_files", where)
    assert keyed(got, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_op7(spark, where):
    want = []
    for i, t, _ in docs_of(where):
        t = t or ""
        words = regex.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    got = run(spark, "op7_quality", where)
    assert keyed(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    if where == SF:
        label = {r["doc_id"]: r["quality"] for r in read(SF, "labels")}
        assert all(r["kept"] for r in got if label.get(r["doc_id"]) == 1 and not r["base_failed"])
        assert not any(r["kept"] for r in got if label.get(r["doc_id"]) == 0 and r["n_symbols"] > r["n_words"])


def _removed_lines(docs):
    """Lines of the rows in the order of (id, text hash), each row a document of its own."""
    t = Fraction(4, 5)
    own = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, docs[r][1] is not None,
                                                  hashlib.md5((docs[r][1] or "").encode()).hexdigest()))
    place = {r: k for k, r in enumerate(own)}
    lines = [(place[r], k, set(x.split())) for r, (_, text, _) in enumerate(docs) if text
             for k, x in enumerate(text.encode().lower().split(b"\n")) if x.split()]
    out = set()
    for a, b in itertools.combinations(lines, 2):
        if min(len(a[2]), len(b[2])) < t * max(len(a[2]), len(b[2])):
            continue
        common = len(a[2] & b[2])
        if common >= t * (len(a[2]) + len(b[2]) - common):
            out.add(max(a[:2], b[:2]))
    return out, {x[:2] for x in lines}, place


def test_op8(spark, where):
    docs = docs_of(where)
    gone, every, place = _removed_lines(docs)
    want = []
    for r, (i, _, _) in enumerate(docs):
        k = place[r]
        mine = sorted(line for d, line in gone if d == k)
        want.append((i, sum(d == k for d, _ in every), len(mine), mine))
    assert keyed(run(spark, "op8_line_dedup", where), "doc_id", "n_lines", "n_removed", "removed_lines") == sorted(want, key=repr)
    assert gone


def test_op9(spark, where):
    docs = docs_of(where)
    got = run(spark, "op9_sharding", where)
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs]
    assert keyed(got, "doc_id", "size", "text_crc32") == sorted(want, key=repr)
    load, slots, group = Counter(), {}, {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        group.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert set(load) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if where == SF:
        total = sum(load.values())
        assert max(load.values()) <= total / 16 + max(r["size"] for r in got)
        assert all(len(s) == 1 for c, s in group.items() if sum(r["size"] for r in got if r["text_crc32"] == c) * 16 < total)


def test_op9_deals_one_hot_text_without_ids(spark):
    """60 % of the rows are one text and have no id: all shards stay near equal."""
    from gridlens.llm import sharding
    hot = [(None, "the same long text " * 10)] * 600
    frame = spark.createDataFrame(hot + [(k, f"text {k} " * 24) for k in range(400)], "doc_id long, text string").repartition(7)
    got = sharding.assign(frame, "doc_id", "text").collect()
    load, rows = Counter(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
    assert len(got) == 1000 and len(load) == 16
    assert max(load.values()) <= 1.1 * sum(load.values()) / 16
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, x) for k in range(16) for x in range(rows[k])]


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = regex.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), regex.match(r"[^?#]*", rest[len(host):]).group()


def test_op10(spark, where):
    got = run(spark, "op10_url_filter", where)
    want = []
    for r in read(where, "pages"):
        host, path = _split(clean(r["url"]))
        fits = [(len(x), x, how) for how, x in Q.RULES
                if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/"):])]
        want.append((None if clean(r["page_id"]) is None else int(r["page_id"]), host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None))
    assert keyed([r | {"v": r["verdict"] if r["rule"] else None} for r in got], "page_id", "host", "path", "rule", "v") == sorted(want, key=repr)
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    for r in got:
        if not r["rule"] and any(x in r["host"] for x in ("pills", "casino", "spam-farm", "ads-track", "free-bets")):
            assert r["verdict"] == "block", r
        if not r["rule"] and regex.match(r"(\w+\.)?th\w+\.example", r["host"]):
            assert r["verdict"] == "allow", r
