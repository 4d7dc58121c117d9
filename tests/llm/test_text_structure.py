"""Runs, prefix tries and piece encoding against plain forms of the same."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from strophe.llm import pieces, queries, runs, trie

DOC = "doc_id long, text string, ids string, runs string"


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_texts():
    rnd, fib = random.Random(5), ["a", "a b"]
    while len(fib[-1]) < 1200:
        fib.append(fib[-1] + " " + fib[-2])
    texts = [None, "", " \t\n", "one", "x " * 11, "x " * 12, "a b\x0bc\x0cd\re " * 3, "    " * 20, fib[-1], "y " * 3000]
    for _ in range(150):
        k, n, p = rnd.choice([1, 2, 3, 5, 40]), rnd.randrange(90), rnd.randrange(1, 14)
        words = [str(rnd.randrange(k)) for _ in range(n)]
        tail = rnd.randrange(n) if n else 0
        texts.append(" ".join(w if i < tail or tail + p > n else words[tail + (i - tail) % p] for i, w in enumerate(words)))
    return texts


def test_runs_match_a_plain_search(spark):
    texts = some_texts()
    rows = [(k, x, "kept", "replaced") for k, x in enumerate(texts)] + [(None, "z " * 20, None, None), (0, None, None, None)]
    got = runs.periodic_runs(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r.text or "").encode().split()
        want = plain_runs(words)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [(x.start, x["length"], x.period) for x in r.runs] == want
        assert r.n_words == len(words) and r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert {r["ids"] for r in got} == {"kept", None}
    assert not runs.periodic_runs(spark.createDataFrame([], DOC)).collect()


def test_grammar_extensions_are_exact():
    rnd = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 9):
        text = np.concatenate([[100], rnd.integers(0, alphabet, 700), [101]])
        levels = runs.recompressed(text, 2)
        a = rnd.integers(1, 700, 400)
        b = np.minimum(a + rnd.integers(1, 300, 400), 700)
        keep = a < b
        a, b = a[keep], b[keep]
        for step in (1, -1):
            for x, y, n in zip(a, b, runs.extension(levels, a, b, step), strict=True):
                k = 0
                while text[x + step * k] == text[y + step * k]:
                    k += 1
                assert n == k


def plain_trie(rows):
    paths = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        paths.setdefault(c, []).append((role or "", text or ""))
    members, ended = {}, {}
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ended.setdefault(tuple(path), []).append(c)
    out, inner = [], {x[:-1] for x in members if x}
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = sum(x not in inner for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(",".join(map(str, ended.get(node, []))).encode()).hexdigest()))
    return sorted(out, key=str)


TURN = "conv_id long, turn long, role string, text string, key string, depth int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_matches_a_plain_one(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", None]), rnd.choice(["a", "b", "", None, "日本"])) for c in range(-3, 40) for t in range(rnd.randrange(6))]
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "tie", "x"), (8, 1, "tie", "y"), (None, 0, "user", "lost"), (99, None, None, None)]
    rows += [(1000, t, "user", "deep") for t in range(150)]
    got = trie.conversation_trie(spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN).repartition(4)).select(*NODE).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)
    assert not trie.conversation_trie(spark.createDataFrame([], TURN)).collect()


def test_trie_over_shards_and_pieces_of_end_lists(spark):
    """Two thirds of the conversations are equal: their end list comes from several shards."""
    rows = [(c, t, "user", "same" if c % 3 else f"{c}-{t}") for c in range(3 * trie.CONVERSATIONS) for t in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = trie.shard_tries(trie.turns(frame).repartition(2))
    assert found.select("shard").distinct().count() >= 3
    got = {(r.conv_id, r.depth): r for r in trie.conversation_trie(frame).collect()}
    same = [c for c in range(3 * trie.CONVERSATIONS) if c % 3]
    assert got[1, 2].n_convs == len(same) > 2 * trie.PIECE
    assert got[1, 2].ends_sha256 == hashlib.sha256(",".join(map(str, same)).encode()).hexdigest()
    root = got[0, 0]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens, root.parent_conv_id) == (len(rows) // 2, trie.CONVERSATIONS + 1, trie.CONVERSATIONS + 1, 8 * (len(same) - 1), None)


def test_shared_openings_may_leave_no_turns(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 140)]
    got = trie.shared_opening_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("depth = 0").collect()
    assert [r.n_convs for r in got] == [39]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_match_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids"), F.lit("y").alias("runs"))
    odd = [None, "", " ", "  a  b ", "▁x ▁▁ y", "\n\n\t x", "日本語 🎉🎉 é́ <s> </s> <0x0A>", "a" * 3000, "\u0001", "x　y\xa0z", " " * 40 + "x", "same", "same"]
    docs = docs.unionByName(spark.createDataFrame([(-k, x, "x", "y") for k, x in enumerate(odd)], docs.schema))
    got = pieces.decoded(pieces.encoded(docs)).collect()
    assert len(got) == docs.count() and {r.runs for r in got} == {"y"}
    for r in got:
        want = library.encode(r.text or "", return_type="proto").pieces
        assert list(zip(r["ids"], r.begins, r.ends, strict=True)) == [(x.id, x.begin, x.end) for x in want]
        assert r.decoded == library.decode(r["ids"])
    empty = pieces.decoded(pieces.encoded(spark.createDataFrame([], DOC)))
    assert empty.columns == ["doc_id", "text", "runs", "ids", "begins", "ends", "decoded"] and not empty.collect()


def test_any_ids_decode_as_in_the_library(library):
    rnd, own = random.Random(1), pieces.model(pieces.MODEL)
    for _ in range(1000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(10)]) for _ in range(rnd.randrange(8))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
def test_compiled_character_maps_keep_offsets(extra, dummy):
    rules = proto.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    file = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        file.ParseFromString(f.read())
    file.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    file.normalizer_spec.remove_extra_whitespaces, file.normalizer_spec.add_dummy_prefix = extra, dummy
    file = file.SerializeToString()
    own, theirs, rnd = pieces.Model(file), sentencepiece.SentencePieceProcessor(model_proto=file), random.Random(2)
    pool = [*"abc  ABÀé ﬁ①½ｱﾞ　\t\n¨ß日🎉…ΑΆ", "ﷺ", "가", "각", "é", "​", "­"]
    for _ in range(500):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(25)))
        want = theirs.encode(text, return_type="proto").pieces
        got = [x.tolist() for x in own.encode(text)]
        assert list(zip(*got, strict=True)) == [(x.id, x.begin, x.end) for x in want]
        assert own.decode(got[0]) == theirs.decode(got[0])


def test_long_stretches_merge_as_short_ones():
    own, rnd = pieces.model(pieces.MODEL), random.Random(4)
    for _ in range(300):
        part = [rnd.choice("▁aenrstio") for _ in range(rnd.randrange(40))]
        assert own.joined(list(part)) == own.joined_long(list(part))
    text, number_of = "▁the▁end,.\n日x▁▁ß", own._neighbours
    cut = own.stretches(text)
    with open(pieces.MODEL, "rb") as f:
        large = pieces.Model(f.read())
    number, many, table = number_of
    large.__dict__["_neighbours"] = number, many, np.flatnonzero(table)
    assert large.stretches(text) == cut and "".join(cut) == text and len(cut) > 4


def test_other_models_are_refused():
    file = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        file.ParseFromString(f.read())
    file.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.Model(file.SerializeToString())


def test_stretches_merged_together_as_one_by_one():
    """Rows of a table, each stretch for itself, and the library's pieces; sizes differ, some characters are no piece."""
    own = pieces.model(pieces.MODEL)
    texts = ["the international cooperation of überraschende Zusammenhänge", "aaaaaaaaaaaaaaaaabababab", "schschschßß éèê ñandú", "日本語 한국어 \U0001f600 x", "a" * 200, "", " "] + ["word%dling" % k * (k % 4) for k in range(300)]
    cuts = [own.stretches(own.normalised(x)[0]) if own.normalised(x)[0] else [] for x in texts]
    each = sorted({y for x in cuts for y in x if len(y) <= pieces.SHORT} | {x[:60] for x in texts if x.strip()}, key=len)
    assert own._merged_rows(each) == [own.merged(x) for x in each] and len(each) > pieces.FEW
    own.known.clear()
    together = [x[0].tolist() for x in own.encode_all(texts)]
    assert together == [own.encode(x)[0].tolist() for x in texts] == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)


def test_piece_encoding_is_one_pass(spark):
    docs = spark.createDataFrame([(1, "über das  Wort 🎉", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "a" * 90, "x", "y")], DOC)
    for back in ("decoded", "text_back", "runs"):
        got = pieces.encoded(docs, back=back)
        assert got.columns[-1] == back and got.sort("doc_id").collect() == pieces.decoded(pieces.encoded(docs.drop(back)), out=back).sort("doc_id").select(got.columns).collect()
    plan = queries.op13_piece_encoding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize(("equal_hashes", "kept", "at_once"), [(True, 500_000, 1_000_000), (False, 40, 1_000_000), (False, 500_000, 50), (True, 3, 50)])
def test_stretches_found_by_hash_are_compared(library, monkeypatch, equal_hashes, kept, at_once):
    """Also where all hashes are equal, hardly any stretch is kept, or a text is longer than what is encoded at once."""
    with open(pieces.MODEL, "rb") as f:
        own, rnd = pieces.Model(f.read()), random.Random(6)
    monkeypatch.setattr(pieces, "CACHE", kept)
    monkeypatch.setattr(pieces, "AT_ONCE", at_once)
    if equal_hashes:
        own.known.weights[:] = 0
    texts = ["", " ", "🎉🎉 日本", "\0\0", "\0", "a" * 500, *("".join(rnd.choice("▁ aenrstio,\n日\0🎉") for _ in range(rnd.randrange(200))) for _ in range(120)), ""]
    for some in (texts, [], texts[:2], texts[::-1], ["word and " * 300]):
        want = [[(x.id, x.begin, x.end) for x in library.encode(y, return_type="proto").pieces] for y in some]
        assert [list(zip(*(x.tolist() for x in made), strict=True)) for made in own.encode_all(some)] == want
    assert len(own.known) == 1 if equal_hashes else len(own.known) > 1


def test_known_stretches_survive_growth():
    known, rnd = pieces.Known(), np.random.default_rng(7)
    hashes = np.unique(np.append(rnd.integers(1, 2**64, 60_000, np.uint64), np.arange(2**64 - 200, 2**64, dtype=np.uint64)))
    for part in np.array_split(hashes, 7):
        assert not known.find(part).any()
        known.add(part, ["ab"] * len(part), [b"12345678" * 2] * len(part))
    assert known.find(hashes).tolist() == list(range(1, len(hashes) + 1)) and len(known) == len(hashes)
    assert (np.diff(known.char_at)[1:] == 2).all() and (np.diff(known.piece_at)[1:] == 2).all()
