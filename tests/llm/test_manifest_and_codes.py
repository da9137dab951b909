"""Merkle manifest, byte-level BPE and fill-in-the-middle: brute force, exact round trips and odd rows."""

import hashlib
import random
import re
import struct
import unicodedata
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from labelmill.llm import byte_bpe, fill_middle, merkle
from tests.llm.test_operators import LONG, ODD, table

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """The root and each leaf's proof, level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fanout * fanout : k // fanout * fanout + fanout]
            proofs[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
            at[i] = k // fanout
        nodes = [H("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], proofs


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (3, 1), (2, 8)])
def test_manifest(spark, fanout, levels):
    rng = random.Random(9)
    groups = [None, "", "a", "z", "é", "-"]
    rows = [(rng.choice([None, rng.randrange(60)]), rng.choices(groups, [1, 2, 30, 3, 1, 9])[0], f"text {i % 50}") for i in range(150)] + [(7, "lone", LONG), (1, "two", None), (1, "two", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("g", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("node", F.lit(2))
    fields = [F.col(c) for c in ("doc_id", "lang", "text")]
    got = merkle.manifest(df, merkle.leaf_hash(fields), "lang", "doc_id", ["doc_id", "lang", "g", "pos"], fanout=fanout, levels=levels)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("forged", merkle.fold(F.lit(H("x")), F.col("proof"))).collect()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    held = {}
    for doc, lang, text in rows:
        held.setdefault(lang, []).append((doc is not None, doc or 0, H(part(doc) + part(lang) + part(text))))
    order = sorted(held, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(held[g])], fanout) for g in order}
    root, across = tree([trees[g][0] for g in order], fanout)
    want = sorted((str(g), leaf, trees[g][0], root, str(p + q)) for g, q in zip(order, across, strict=True) for (_, _, leaf), p in zip(sorted(held[g]), trees[g][1], strict=True))
    assert sorted((str(r.row.lang), r.leaf, r.subroot, r.root, str([tuple(s) for s in r.proof])) for r in got) == want
    assert {r.folded for r in got} == {root} and root not in {r.forged for r in got} and {r.row.g for r in got} == {"clash"}


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, None, "x")], "doc_id long, lang string, text string")
    one = merkle.manifest(df, merkle.leaf_hash([F.col("text")]), "lang", "doc_id", ["doc_id"]).first()
    assert one.leaf == one.subroot == one.root == H("1:x") and one.proof == []
    assert merkle.manifest(df.limit(0), merkle.leaf_hash([F.col("text")]), "lang", "doc_id", ["doc_id"]).count() == 0


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_codes(spark):
    rng = random.Random(5)
    ranks = byte_bpe.read_ranks(PATH)
    model = byte_bpe.serialise_model(ranks)
    known = [c for c in map(chr, [*range(0x250), *range(0x2000, 0x2100), *range(0x3000, 0x3200), *range(0x1F300, 0x1F600)]) if unicodedata.category(c) not in ("Cn", "Cs")]
    odd = ["".join(rng.choices(known, k=rng.randrange(200))) for _ in range(200)]
    odd += ["x" * 30_000, " " * 3000, "\r\n \t" * 500, "\0<unk>▁ ▁", "don't I'LL we've", "<|endoftext|>", "the" * 400_000]
    tokens = [t.decode() for t in list(ranks)[:5000] if not t[-1] & 128]
    odd += ["".join(rng.choices(tokens, k=50)) for _ in range(100)]
    rows = table(spark, [*ODD, *[(100 + i, t) for i, t in enumerate(odd)]]).withColumn("ids", F.lit("clash")).withColumn("source", F.lit("clash"))
    coded = byte_bpe.encode(rows, model, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded, model, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = back.collect()
    assert len(got) == len(ODD) + len(odd) and back.columns == [*[c for c in rows.columns if c != "ids"], "ids", "decoded"]
    for r in got:
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert r.source == r.lang == "clash"
    assert byte_bpe.encode(rows.limit(0), model, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="every single byte"):
        byte_bpe.serialise_model({b"a": 0})


def test_codes_are_the_same_when_forgotten(monkeypatch):
    ranks = byte_bpe.read_ranks(PATH)
    model, texts = byte_bpe.serialise_model(ranks), ["one two three " * 5, "four five " + "y" * 200, None, "six one"]
    want = byte_bpe.Codec(model, public_tokenizers.PATTERN).encode(texts)
    for name, value in (("KEPT", 3), ("KEPT_CHARS", 4), ("_LONG_TEXT", 5), ("_PART", 2)):
        monkeypatch.setattr(byte_bpe, name, value)
        codec = byte_bpe.Codec(model, public_tokenizers.PATTERN)
        assert codec.encode(texts) == want and list(codec.decode(want)) == [(t or "").encode() for t in texts]


def test_middle(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["ab", "Z", " ", "é", "😀", "<", "P>", "S", ">", "\n", "<M", "1"], k=rng.randrange(40))) for _ in range(400)] + ["a <S> b", "word", "<" * 9]
    rows = table(spark, [*ODD, *[(1000 + i, t) for i, t in enumerate(texts)]]).withColumn("form", F.lit("clash")).withColumn("source", F.lit("clash"))
    done = fill_middle.restore(fill_middle.render(fill_middle.fill_in_middle(rows)))
    got, forms = done.collect(), set()
    assert len(got) == len(ODD) + len(texts)
    for r in got:
        text = r.text or ""
        units, h = re.findall("[A-Za-z]+|[^A-Za-z]", text), H("1:" + ("" if r.doc_id is None else str(r.doc_id)))
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) == (len(units), form, *lengths, output, text)
        assert (r.output_sha256, r.restored_sha256) == (H(output), H(text)) and r.source == r.lang == "clash"
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and fill_middle.fill_in_middle(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="Not an output"):
        fill_middle.restored(b"text", "psm")


def test_draw_is_that_of_sql(spark):
    row = spark.range(1).select(F.sha2(F.lit("1:5"), 256).alias("h")).first()
    assert fill_middle.draw("1:", 5) == tuple(int(row.h[8 * i : 8 * i + 8], 16) for i in range(4))
    assert zlib.crc32(b"5") == spark.range(1).select(F.crc32(F.lit("5"))).first()[0]
