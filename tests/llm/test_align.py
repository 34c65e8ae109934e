"""Cross-tokenizer alignment against a plain walk over byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from broadsheet.llm import align


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def plain(texts, library):
    """``(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)`` of each text by the definition."""
    a, b = library
    letters = align.byte_letters()
    walked = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [align.Tokenizers._piece(b.id_to_piece(i)) for i in ids_b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            walked.append(([], 0, 0))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= cut],
                           [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= cut]))
            low = cut
        walked.append((groups, len(ids_a), len(ids_b)))
    links = [[(x, y) for one, two in groups for x in one for y in two] for groups, _, _ in walked]
    count = Counter(pair for own in links for pair in set(own))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (groups, n_a, n_b), own in zip(walked, links, strict=True):
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in groups)
        out.append((n_a, n_b, len(groups), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    pieces = ["the ", "résumé ", "naïve", "漢字", "🙂🙂", "\n\n", "  ", "\t", "don't ", "2024", "...", "Größe ", "internationalisation ",
              "q" * 9, "<|endoftext|>", "<s>", "<0x41>", "é", "عربى ", " ", "　"]
    out = [None, "", " ", "a", "\x00", "a▁b", "▁", "<unk>", "ﬁne", "é", "x" * 3000, "漢" * 700, "ab " * 1500,
           "\n" * 500, "zq" * 1200 + " end"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(rng.randrange(1, 80)))
            for _ in range(60)]
    return [*out, out[20], out[20], None]


@pytest.mark.parametrize("options", [{}, {"frequent": 300, "lane": 5, "large": 3}, {"frequent": 0, "lane": 1}])
def test_equals_plain_walk(spark, texts, library, options):
    rows = [(i if i != 30 else None, t, 7, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid long, pairs string").repartition(3)
    want = [(r[0], *x) for r, x in zip(rows, plain(texts, library), strict=True)]
    got = [tuple(r) for r in align.alignment(docs, **options).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(none).count() == 0
    docs = spark.createDataFrame([("b", "one two"), ("a", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_a, r.n_b, r.groups_sha256 != "") for r in align.alignment(docs).collect()}
    assert got == {"b": (2, 2, True), "a": (0, 0, False)}


def test_lanes_start_at_common_ends_and_one_group_may_be_large():
    end_a, end_b = np.array([2, 4, 6, 8, 10, 12]), np.array([3, 6, 7, 8, 12])
    docs_a, docs_b = np.array([0, 4, 4, 6]), np.array([0, 4, 4, 5])
    starts = align.lanes(end_a, end_b, docs_a, docs_b, 1)
    assert [x.tolist() for x in starts] == [[0, 3, 4], [3, 4, 6], [0, 2, 4]]
    groups, (left, right), rest = align.lockstep(end_a, end_b, starts, 4)
    assert sorted(groups.T.tolist()) == [[0, 3, 0, 2], [3, 4, 2, 4], [4, 6, 4, 5]]
    assert rest.T.tolist() == [[0, 3, 0, 2]]
    assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == [(3, 2), (3, 3), (4, 4), (5, 4)]
