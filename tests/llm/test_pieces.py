"""SentencePiece encoding, cross-tokenizer alignment and ranked search against the libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm import alignment, pieces, ranked, tokens

ALPHABET = [*"aeinst  \n\t▁éﬁ①½　ｶﾞ日😀 \x00\x01​.,'10<>|", "́", "\xad", "  ", "the ", "tion", "\r\n", "</s>", "<0x0A>", "<|endoftext|>"]
EDGES = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁▁x", " \n ", "é", "😀 😀a", "​", "​a", "<s> x</s>", "\x00", "a\x00b", "<|endoftext|>", "x" * 20000, "ab c. " * 3000]
DOCS = "doc_id bigint, text string, ids string, begins int, id string, n int, shard int, block string, _text string"


def texts(seed, n):
    r = random.Random(seed)
    return EDGES + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, "b", "t") for i, t in rows], DOCS).repartition(3)


def model_with(rule, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec, model = pb.NormalizerSpec(), pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.remove_extra_whitespaces = spec.precompiled_charsmap, squeeze
    return model.SerializeToString()


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nfkc_cf", "nfkc"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_ids_texts_and_spans_equal_the_library(rule, squeeze):
    """With compiled character maps, whose keys of several characters become one or none, and with the model's own."""
    with open(pieces.default_model(), "rb") as f:
        proto = model_with(rule, squeeze) if rule else f.read()
    own, library, some = pieces.Pieces(proto=proto), sentencepiece.SentencePieceProcessor(model_proto=proto), texts(5, 400)
    ids, starts, begins, ends = own.encode(pa.array(some, pa.large_string()))
    decoded = own.decode(ids, starts).to_pylist()
    for k, t in enumerate(some):
        mine = slice(starts[k], starts[k + 1])
        assert ids[mine].tolist() == library.encode(t), t
        assert decoded[k] == library.decode(library.encode(t)), t
        want = library.encode(t, return_type="proto").pieces
        assert ends[mine].tolist() == [p.end for p in want], t
        if not (squeeze and rule == "nmt_nfkc"):  # there the put-in space may begin before characters that vanish
            assert begins[mine].tolist() == [p.begin for p in want], t


def test_decoding_of_any_ids():
    own, library, r = pieces.Pieces(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), random.Random(8)
    some = [[r.choice([r.randrange(3, 259), r.randrange(0, 32000), 0, 1, 2]) for _ in range(r.randint(0, 9))] for _ in range(500)]
    flat = np.array([i for ids in some for i in ids], np.int64)
    got = own.decode(flat, np.append(0, np.cumsum([len(ids) for ids in some]))).to_pylist()
    assert got == [library.decode(ids) for ids in some]


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="BPE"):
        pieces.Pieces(proto=model.SerializeToString())
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Encoder(tokens.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k"))


def test_encoding_of_a_table(spark):
    rows = [*enumerate(texts(6, 60)), (None, "no id"), (7, None), (7, None)]
    got = pieces.round_trip(frame(spark, rows)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert sorted((r["doc_id"] or -1, r["ids"], r["decoded"], r["n"]) for r in got) == sorted((i or -1, library.encode(t or ""), library.decode(library.encode(t or "")), 2) for i, t in rows)
    for r in got:  # spans follow each other and end with the text
        raw = (r["text"] or "").encode()
        assert all(a <= b for a, b in zip(r["begins"], r["ends"])) and (not raw or r["ends"][-1] == len(raw))
    assert pieces.encode(frame(spark, []).filter("false")).count() == 0


def brute_alignment(rows):
    a_tok, b_tok, letters = Tokenizer.from_file(tokens.default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), alignment._letters()
    a_tok.encode_special_tokens = True
    out, links, count = [], [], Counter()
    for key, text in rows:
        base = (" " + (text or "")).encode()
        a = a_tok.encode(base.decode(), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_raw = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:-1], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if b"".join(a_raw) != base or b"".join(b_raw) != base:
            a, b, a_raw, b_raw = [], [], [], []
        a_ends, b_ends = np.cumsum([len(x) for x in a_raw]).tolist(), np.cumsum([len(x) for x in b_raw]).tolist()
        groups, last = [], 0
        for c in sorted({*a_ends} & {*b_ends}):
            groups.append(",".join(str(i) for i, e in zip(a, a_ends) if last < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, b_ends) if last < e <= c))
            last = c
        pairs = [(i, j) for i, e, x in zip(a, a_ends, a_raw) for j, f, y in zip(b, b_ends, b_raw) if max(e - len(x), f - len(y)) < min(e, f)]
        count.update(pairs)
        links.append(pairs)
        out.append((key, len(a), len(b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*o[:5], sum(count[p] == best[p[1]] for p in ps), sum(count[p] for p in ps), o[5]) for o, ps in zip(out, links)]


def test_galloping():
    r = random.Random(3)
    for _ in range(400):
        x, y = (np.array(sorted(r.sample(range(300), r.randint(0, 200)))) for _ in range(2))
        assert alignment.gallop(x, y).tolist() == np.searchsorted(y, x).tolist()


def test_alignment_of_a_table(spark, monkeypatch):
    rows = [*enumerate(t for t in texts(9, 80) if len(t) < 1000), (7, None), (7, None), (None, "no id here"), (8, "the same text"), (8, "the same text")]
    monkeypatch.setattr(alignment, "BLOCK", 200)  # workers see the module's value only where they are forked after this
    got = [tuple(r) for r in alignment.cross_tokenizer(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_alignment(rows), key=repr)
    assert alignment.cross_tokenizer(frame(spark, []).filter("false")).count() == 0


def test_alignment_lists(spark):
    rows = list(enumerate(["the tokenization of naïve words", "x", "", "▁"]))
    got = {r["doc_id"]: r for r in alignment.align(frame(spark, rows)).collect()}
    for key, *want in brute_alignment(rows):
        r, parts, i, j = got[key], [], 0, 0
        for x, y in zip(r["a_cuts"], r["b_cuts"]):
            parts.append(",".join(map(str, r["a_ids"][i:x])) + "|" + ",".join(map(str, r["b_ids"][j:y])))
            i, j = x, y
        assert (hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "") == want[-1]
        assert (len(r["a_ids"]), len(r["b_ids"])) == tuple(want[:2])


def test_blocks_count_pairs():
    block = alignment.Block()
    codes = [np.array([5, 3, 5, 9]), np.array([], np.int64), np.array([3, 4, 9, 9, 1 << 33])]
    numbers = [block.number(c) for c in codes]
    names = {}
    for c, n in zip(codes, numbers):
        for x, k in zip(c.tolist(), n.tolist()):
            assert names.setdefault(k, x) == x
    assert {names[k]: v for k, v in enumerate(block.counts.tolist())} == {5: 2, 3: 2, 9: 3, 4: 1, 1 << 33: 1}


def brute_ranking(rows, items, k):
    words = lambda t: re.findall(ranked.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n_docs, n_terms, out = len(docs), sum(c.total() for _, c in docs), []
    df = Counter(t for _, c in docs for t in c)
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in {*words(text)} if c[t])
            if s > 0:
                scored.append((-s, i is not None, i, s))
        out += [(item, n + 1, i, s) for n, (_, _, i, s) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first, shard", [(32, 10**6), (2, 300)])
def test_ranked_search(spark, monkeypatch, first, shard):
    """Zipf-like words, copies, a word in all documents, and both rounds of shards."""
    monkeypatch.setattr(ranked, "FIRST", first)
    monkeypatch.setattr(ranked, "SHARD", shard)
    r = random.Random(4)
    word = lambda: f"W{int(r.paretovariate(0.7)) % 300}"
    rows = [(i, "all " + ". ".join(word() for _ in range(r.randint(0, 60)))) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(70)] + [(3, rows[3][1]), (2000, None), (2001, ""), (2002, "?!"), (None, "all W1 w1"), (2003, "É é W1 ÉW1 " * 3000)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 30)))) for i in range(20)] + [(90, rows[3][1]), (91, None), (92, "--"), (93, "missing word"), (94, "all"), (90, rows[3][1]), (95, "é ÉW1 w1")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(x) for x in ranked.ranked_search(frame(spark, rows), table, 10).collect()), key=repr)
    assert got == brute_ranking(rows, items, 10)
    assert ranked.ranked_search(frame(spark, []).filter("false"), table).count() == 0
    assert ranked.ranked_search(frame(spark, rows[:3]), table.filter("false")).count() == 0


def test_pair_bounds_skip():
    """Two heavy terms that never meet: their pair's bound is that of one, which leaves the pair out."""
    lists = lambda o, i: (np.array(o), np.array(i), max(i))
    single = {0: lists([0, 1], [9, 9]), 1: lists([2, 3], [8, 8]), 2: lists([0, 4, 5], [20, 20, 20])}
    found, got = ranked.best_of([(0, 1), (2, -1)], single, {}, 6, 3, 10)
    assert found.tolist() == [0, 4, 5] and got.tolist() == [29, 20, 20]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 3)
    rows, items = [(i, f"a{i % 3} b{i % 5} c{i % 7}") for i in range(40)], [(i, f"a{i % 3} c{i % 4}") for i in range(5)]
    got = sorted((tuple(x) for x in ranked.ranked_search(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), 5).collect()), key=repr)
    assert got == brute_ranking(rows, items, 5)
