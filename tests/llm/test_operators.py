"""Operators of the training-data folder against plain versions, on small tables with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import archives, bpe, chat, decontaminate, jaccard, licences, quality, sharding, suffixes, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 90)
    shared = words(rng, 60, 10**6)
    out = [None, "", " \n", "One", "one two", "ONE  TWO", "É é É", "<|endoftext|>x", " ".join(base), " ".join(base).upper()]
    for _ in range(12):
        near = list(base)
        near[rng.randrange(90)] = "changed"
        out.append(" ".join(near))
    for _ in range(3):
        out.append(" ".join(words(rng, 30) + shared + words(rng, 20)))
    out.append(" ".join(words(rng, 3000)))
    out.append("a" * 5000 + " MIT License, Apache License; licensed under CC BY-NC 4.0")
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [rows[8], rows[0], (None, texts[8], "en", "s", 1, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, docs, none):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = bpe.encoded(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == docs.count() - 1
    for row in got:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs)).where("doc_id = 9").first().text
    assert back == docs.where("doc_id = 9").first().text
    assert bpe.encoded(none).count() == 0


def _sets(rows, width):
    out = []
    for _, text in rows:
        own = (text or "").encode().lower().split()
        out.append({tuple(own[i:i + width]) for i in range(max(1, len(own) - width + 1))} if own else set())
    return out


def _components(rows, width, num, den):
    sets = _sets(rows, width)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and label[i] != label[j] and den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for (doc, _), root in zip(rows, label, strict=True):
        low[root] = doc if low.get(root) is None else low[root] if doc is None else min(doc, low[root])
    return [(doc, len(s), low[r]) for (doc, _), s, r in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, width, num, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.components_of(docs, width, num, 100).select("doc_id", "n", "component").collect()
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(_components(rows, width, num, 100), key=key)


def test_one_of_each_component_stays(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted({c for _, n, c in _components(rows, 5, 80, 100) if n})
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.where("trim(text) <> '' and text <> ' \n'").collect()]
    assert sorted(got) == expected
    assert kept.where("text is null").count() == 2
    assert jaccard.one_per_component(none).count() == 0


def _spans(rows, least):
    seen, hits = set(), {}
    for doc, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        own = text.encode().lower().split()
        for start in range(len(own) - least + 1):
            run = tuple(own[start:start + least])
            if run in seen:
                spans = hits.setdefault(doc, [])
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = start + least
                else:
                    spans.append([start, start + least])
            seen.add(run)
    return hits


def test_repeated_spans_and_cut(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: [[s["first"], s["end"]] for s in r.spans] for r in suffixes.repeated_spans(docs).collect()}
    assert got == _spans(rows, 50) and got
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 9").count() == 0
    for row in cut.where("doc_id is not null").collect():
        own = (dict(rows)[row.doc_id] or "").split()
        for first, end in reversed(got.get(row.doc_id, [])):
            del own[first:end]
        assert (row.text or "").split() == own
    assert suffixes.cut_repeats(none).count() == 0


def test_quality_scores(spark, docs, none):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40)) + "." if i % 3 else "!! ".join(w.upper() for w in words(rng, 40)))
            for i in range(400)] + [(400, None), (401, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(7, None, 0), (None, 1, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table, labels).collect()}
    assert len(got) == 402
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r.predicted == int(r.doc_id % 3 > 0) for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(table, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    kept = quality.drop_rejected(table, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.quality_scores(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_scores(none, labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 2, 1, 3]), np.ones(4))
    assert x.tolist() == [0, 1.5, 3] and y.tolist() == [0, 1.5, 3]


def test_licences(docs, none):
    got = licences.licences(docs).collect()
    phrases = {tuple(a.encode().split()): b for a, b in licences.BASE.items()}
    assert len(got) == docs.count()
    by_id = {r.doc_id: r.text for r in docs.collect()}
    for row in got:
        own = licences.words_of((by_id[row.doc_id] or "").encode())
        at = [(i, label) for i in range(len(own)) for p, label in phrases.items() if tuple(own[i:i + len(p)]) == p]
        assert row.n_words == len(own) and row.n_base == len(at)
        assert (row.first_word, row.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1
    assert "cc-by-nc-4.0" in next(r.labels for r in got if r.n_base == 3)
    assert licences.licences(none).count() == 0


def test_shards(docs, none):
    keys = sharding.keyed(docs)
    for shards in (3, 16):
        rows = sharding.placed(keys, shards, 2).orderBy("k", "uid").collect()
        total, below = sum(r["size"] for r in rows), 0
        slots = {}
        for row in rows:
            assert row.shard == below * shards // total
            assert row.slot == slots.get(row.shard, 0)
            slots[row.shard] = row.slot + 1
            below += row["size"]
    assert sharding.sharded(docs, 2).count() == docs.count()
    assert sharding.sharded(none).count() == 0


def test_archives(spark):
    page = "x" * 1200
    rows = [(1, "http://a/ b", page), (2, None, page), (3, "http://c", "short"), (4, "http://c", "short"), (5, "", None),
            (6, "http://é", "é\n\r\n\r\nWARC/1.0\r\n"), (7, "http://d", page), (7, "http://d", page)]
    got = archives.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for row in got:
        html = (dict((r[0], r[2]) for r in rows)[row.page_id] or "").encode()
        assert row.payload_bytes == len(html) and row.payload_digest == hashlib.sha1(html).hexdigest()
        again = html.decode() == page and row.page_id != 7
        assert (row.record_type, row.refers_to) == (("revisit", 7) if again else ("response", None))
    assert archives.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    one, two = ("".join(x + "\n" for x in archives.arc_lines(iter([(1, "http://a", "ü")]), "n", v)).encode() for v in "12")
    for data in (one, two):
        (fields, block), = archives.parse_arc(data)
        assert fields["URL"] == "http://a" and archives.split_http(block)[1:] == ("ü".encode(), 1)


def test_chat(spark):
    probe = r"<|im_end|><\|<\\|im_start|>assistant ok <"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (2, 0, "assistant", None), (2, 0, "assistant", None),
            (3, 1, "we<|ird\n%0A", "|x"), (None, 0, None, "a"), (4, 0, "system", "s"), (4, 1, "user", "u"),
            (4, 2, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.conversations(table)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, 3, None, 4):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].loss_text == "".join(t for r, t in own if r == "assistant")
    assert {c for c, r in back.items() if r.valid} == {1, 4}
    assert chat.conversations(table.limit(0)).count() == 0


def test_decontamination(spark, docs, none):
    by_id = {r.doc_id: r.text for r in docs.collect()}
    base = by_id[8].split()
    items = [(1, " ".join(base[5:30])), (2, "one TWO"), (3, None), (4, "..."), (5, " ".join(base[5:30])), (5, "é"),
             (6, "never seen words of an item that is long enough here")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def split(text):
        return licences.words_of((text or "").encode())

    wins = {(tuple(w[i:i + 10]), item) for item, t in items if (w := split(t)) for i in range(max(1, len(w) - 9))}
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == docs.count()
    for row in got:
        own = split(by_id[row.doc_id])
        hit, ids = set(), set()
        for win, item in wins:
            for i in range(len(own) - len(win) + 1):
                if tuple(own[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(str(item))
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(own), len(hit), len(ids), bool(hit))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.integer_vectors(table)
    got = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 16).collect()
    x = {r.vec_id: np.pad(np.array(r.x, int), (0, 8 - len(r.x))) for r in vectors.collect()}
    assert set(x) == set(range(260)) | {303}
    expected = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:20]
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_long_components_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(130, [float(2**18 + 8 * i), 0.0, 0.0, 0.0]) for i in range(3)] + [(131, [float(2**30), 1.0, 0.0, 0.0])]
    rows += [(20, rows[7][1]), (20, [9.0, 9.0, 9.0, 9.0]), (21, rows[5][1]), (21, rows[6][1]), (132, [1e30, 0.0, 0.0, 0.0])]
    rows += [(133, [-1e30, 0.0, 0.0, 0.0]), (40, [0.0, 0.0, 0.0, 5.0])]
    # The first component of all asked rows but one is zero or small, so that no score of 132 passes a bigint.
    rows = [(i, [0.0, *x[1:]] if i % 20 == 0 or i < 120 and i % 3 else x) for i, x in rows]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [(i, [int(np.floor(64 * v)) if abs(v) < 1e15 else int(64 * v) for v in row]) for i, row in rows]
    assert sorted((r.vec_id, [int(v) for v in r.x]) for r in vectors.collect()) == sorted(x)

    def check(asked, k, top):
        got = topk.top_k(vectors, vectors.where(f"vec_id in ({', '.join(map(str, asked))})"), k, 16).collect()
        expected = []
        for q in asked:
            pairs = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), c)
                           for i, u in x if i == q for c, v in x if c != q)[:k]
            expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(pairs)]
        assert sorted(map(tuple, got)) == sorted(expected)
        assert max(r.score for r in got) > top

    check([0, 20, 40, 60, 80, 100], 20, 10**4)
    vectors = vectors.where("vec_id < 132")
    x = [(i, v) for i, v in x if i < 132]
    check([3, 20, 130], 20, 2**53)
    with pytest.raises(Exception, match="exceeds a bigint"):
        long = topk.integer_vectors(spark.createDataFrame([(1, [1e30]), (2, [1e30])], "vec_id long, embedding array<double>"))
        topk.top_k(long, long).collect()


def test_rows_without_id_are_searched_and_cut(spark, tmp_path):
    rng = random.Random(8)
    passage, other, own = (words(rng, n, 10**6) for n in (60, 55, 70))
    rows = [(7, " ".join(passage + own)), (None, " ".join(words(rng, 5, 10**6) + passage)), (None, " ".join(passage)),
            (None, " ".join(other + ["one"])), (None, " ".join(["two"] + other)), (2**40, " ".join(own)), (None, None)]
    table = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], DOCS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in suffixes.op3_suffixes(spark, str(tmp_path)).collect()]
    key = lambda r: (str(r[0]), r[1])
    found = [(None, [(0, 60)]), (None, [(5, 65)]), (2**40, [(0, 70)])]
    assert sorted(got, key=key) in [sorted([*found, (None, [x])], key=key) for x in ((0, 55), (1, 56))]
    cut = [r.text for r in suffixes.cut_repeats(table).collect()]
    assert len(cut) == 5 and sum(passage[0] in (t or "").split() for t in cut) == 1
    assert sum(other[0] in (t or "").split() for t in cut) == 1


def test_archives_of_other_writers(spark, tmp_path):
    import gzip
    image, latin = b"HTTP/1.1 200 OK\r\n\r\n\x89PNG\xff\x00\n\xfe", "HTTP/1.1 200 OK\r\n\r\nGr\xfc\xdfe".encode("latin-1")
    about = b"1 0 other\nURL IP-address Archive-date Content-type Archive-length\n"

    def record(url, kind, block):
        return b"%s 0.0.0.0 20040102030405 %s %d\n%s\n" % (url, kind, len(block), block)

    parts = [record(b"filedesc://x.arc", b"text/plain", about), record(b"http://a/i", b"image/png", image),
             record(b"filedesc://page", b"text/html", latin), record(b"filedesc://text", b"text/plain", latin),
             record("http://a/ü".encode("latin-1"), b"text/html", latin)]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/plain.arc").write_bytes(b"".join(parts))
    (tmp_path / "arc/members.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    records = archives.arc_records(spark, str(tmp_path / "arc"))
    archives.write_warcs(records, str(tmp_path / "warc"))
    got = sorted((r.uri, r.payload_digest) for r in archives.warc_records(spark, str(tmp_path / "warc")).collect())
    want = [("http://a/i", image), ("filedesc://page", latin), ("filedesc://text", latin), ("http://a/%FC", latin)]
    assert got == sorted((u, hashlib.sha1(b.partition(b"\r\n\r\n")[2]).hexdigest()) for u, b in want * 2)
