"""Whitening, token files and the prefix trie against plain versions, with their edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaykit.llm import prefix_trie as trie
from assaykit.llm import token_files as files
from assaykit.llm.queries import QUERIES
from assaykit.llm.whitening import right_solve, whiten
from assaykit.session import read_table, work_path

from . import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def compare_whitened(rows, ids, vectors, components=16):
    n, deviations, whitened, explained = brute.whitening(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    table = np.array([[got[i][c + 1].whitened for c in range(len(explained))] for i in ids])
    signs = np.sign((table * whitened).sum(0))
    assert np.abs(table - whitened * signs).max() < 1e-9
    assert [got[i][1].deviation for i in ids] == deviations.tolist()
    assert np.allclose([got[ids[0]][c + 1].explained for c in range(len(explained))], explained, rtol=1e-9)
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9


def test_whitening_of_the_table(spark, sf):
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    table = read_table(spark, sf, "embeddings").collect()
    compare_whitened(rows, [r.vec_id for r in table], [r.embedding for r in table])


def test_whitening_edges(spark):
    rng = np.random.default_rng(7)
    good = (rng.normal(size=(60, 5)) * [1, 30, 1e-1, 5, 2]).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(good)] + [(100, good[0].tolist(), "copy")] * 2
    bad = [(200, None, ""), (201, [], ""), (202, [1.0, None, 0.0, 0.0, 0.0], ""), (203, [float("nan")] * 5, ""), (204, [float("inf")] + [0.0] * 4, "")]
    schema = "vec_id long, embedding array<float>, component string"
    out = whiten(spark.createDataFrame([(*r[:2], None) for r in rows + bad], schema))
    once = out.dropDuplicates(["vec_id", "component"]).collect()
    compare_whitened(once, [*range(60), 100], [*good, good[0]], 5)
    assert out.filter("vec_id = 100").count() == 10
    assert whiten(spark.createDataFrame(bad, schema)).count() == 0
    # a constant and a dependent dimension have no variance; one distinct vector has none at all
    flat = spark.createDataFrame([(i, [float(v), 2 * float(v), 3.0], None) for i, v in enumerate(rng.integers(-9, 9, 40))], schema)
    parts = sorted((r.component, r.whitened is None, round(r.explained, 9)) for r in whiten(flat).filter("vec_id = 0").collect())
    assert parts == [(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)]
    assert {r.whitened for r in whiten(spark.createDataFrame([(1, [1.0, 2.0], None)] * 3, schema)).collect()} == {None}
    with pytest.raises(ValueError, match="different lengths"):
        whiten(spark.createDataFrame([(1, [1.0], None), (2, [1.0, 2.0], None)], schema))


def test_triangular_solve():
    rng = np.random.default_rng(1)
    r = np.triu(rng.normal(size=(70, 70))) + 9 * np.eye(70)
    y = rng.normal(size=(11, 70))
    assert np.allclose(right_solve(y, r) @ r, y)


@pytest.mark.parametrize("n, span", [(1, 0), (1, 9), (6, 0), (1000, 10), (1000, 10 ** 9), (700, 2 ** 63 - 1), (513, 600)])
def test_elias_fano(n, span):
    values = np.sort(np.random.default_rng(n).integers(0, span + 1, n)) - (2 ** 62 if span == 2 ** 63 - 1 else 0)
    stored = files.EliasFano.of(values).tobytes()
    seq, end = files.EliasFano.read(b"--" + stored, 2)
    assert end == len(stored) + 2
    assert seq.get(0, n).tolist() == values.tolist() == [int(seq.get(i)[0]) for i in range(n)]
    assert all(seq.first_at_least(int(v)) == np.searchsorted(values, v) for v in (values[0], values[-1], values[n // 2]))
    if n == 1000:
        assert 8 * len(stored) / n < 2.6 + max(0, np.log2(span / n))
    with pytest.raises(IndexError):
        seq.get(n)


def expected_documents(rows):
    """(doc_id, start, n_tokens, crc32) by the library alone, in the order of the files."""
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark, sf):
    rows = sorted(read_table(spark, sf, "documents").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, sf).collect()) == expected_documents(rows)


def test_token_files_edges(spark):
    long = "word, " * 40_000 + "ende"
    rows = [(None, "no id"), (3, "three's  blanks\n"), (5, None), (6, ""), (9, long), (9, long), (12, "<|endoftext|> é字😀"), (-4, " starts"), (40, "a\x00b")]
    folder = work_path(spark, "tokens-test")
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    manifest = files.write_tokens(frame, folder, TOKENIZER, shards=4).collect()
    got = files.read_tokens(spark, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == expected_documents(order)
    assert sum(m.n_docs for m in manifest) == len(rows) and len(manifest) > 1
    # one document by its place and by its id, through the index alone
    by_id = {r.doc_id: r.ids for r in got}
    for m in manifest:
        shard = files.Shard(folder, m["name"])
        for i, name in enumerate(shard.name_of(0, shard.n)):
            assert shard.document(i).tolist() == by_id[name]
            assert name is None or i in shard.places(name)
    empty = work_path(spark, "tokens-empty")
    files.write_tokens(frame.limit(0), empty, TOKENIZER)
    assert files.read_tokens(spark, empty).count() == 0


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = files.Encoder(open(path, encoding="utf-8").read())
    ids, lengths = encoder.encode(["Two words", ""])
    assert not encoder.byte_level and lengths.tolist()[1] == 1
    assert ids[:lengths[0] - 1].tolist() == Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_encoder_gives_the_ids_of_whole_texts(monkeypatch, seed):
    monkeypatch.setattr(files, "CACHED", 300)  # the cache is emptied between the calls
    spec = open(TOKENIZER, encoding="utf-8").read()
    encoder, library = files.Encoder(spec), Tokenizer.from_str(spec)
    library.encode_special_tokens = True
    rng = np.random.default_rng(seed)
    marks = [" "] * 8 + list("\n\n\n.,'#-%\t\r\x0b\x1c\x85\xa0\u2028\u3000") + ["...", "'s", "\n\n", "  "]
    units = marks + ["word", "Éa", "ß", "\u0250x", "字", "\u0301", "12", "s", "re", "<|endoftext|>", "😀", "\x00"] * 3
    plain = ["one", "two.", "três,", "x'\ns", "four.\nFive", "six***\n7\nEight!", "\nnine", "字.\n字", "it's", "a"]
    for _ in range(6):
        texts = ["".join(rng.choice(units, rng.integers(0, 40))) for _ in range(60)]
        texts += [" ".join(rng.choice(plain, rng.integers(0, 30))) + ["", "\n", "\n\n", " "][rng.integers(0, 4)] for _ in range(60)]
        ids, lengths = encoder.encode(texts)
        got = [part[:-1].tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
        assert got == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_words_on_both_sides_of_a_line_end_are_learnt_once(monkeypatch):
    encoder, sent = files.Encoder(open(TOKENIZER, encoding="utf-8").read()), []
    plain = files.Encoder.library_ids
    monkeypatch.setattr(files.Encoder, "library_ids", lambda self, texts: sent.extend(texts) or plain(self, texts))
    names = [a + b for a in "abcdef" for b in "uvwxyz"]
    encoder.encode(["x " + " ".join(f"{a}.\n{b}" for a in names for b in names) + " x"])
    assert sum(map(len, sent)) < 10 * len(names)  # 1,296 pairs of 36 words


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 64])
def test_trie_edges_over_many_shards(spark, monkeypatch, fan):
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "SHARD_TURNS", 12)  # every few conversations are a shard, so most nodes are boundary nodes
    rng = np.random.default_rng(2)
    rows = [(None, 1, "user", "no conversation")]
    for conv in range(60):
        rows += [(conv, None if t == 3 else t, "user" if t % 2 else None, f"té{rng.integers(0, 2)}" if t != 2 else None) for t in range(int(rng.integers(1, 7)))]
    rows += [(conv, t, "user", f"same {t}") for conv in range(1000, 1100, 5) for t in range(4)]  # one sequence, many conversations
    rows += [(7777, t, "user", f"deep {t}") for t in range(300)] + [(7779, t, "user", f"deep {t}") for t in range(300)]
    rows += [(4001, 1, "user", "twice")] * 2 + [(4001, 1, "user", "tie"), (4003, 0, "u", ""), (4004, 0, None, None)]
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], CONVERSATIONS + ", ids string, depth int")
    assert trie_rows(trie.prefix_trie(trie.branched(trie.sequences(frame)))) == brute.prefix_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert trie.prefix_trie(trie.branched(trie.sequences(empty))).count() == 0


def test_hot_turns_are_joined_in_parts(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c}-{t}") for c in range(400) for t in range(2)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    assert trie_rows(trie.prefix_trie(trie.branched(trie.sequences(frame)))) == brute.prefix_trie(rows)
