"""Alignment, packing and ranked search against plain versions on odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabspark.llm import alignment, byte_tokens, packing, ranked
from tabspark.llm.common import ship

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\t\t x", "x\n\n\ny", "don't we'll", "x<|endoftext|>y", "z <|endoftext|> q", "a▁b", "▁", "…—“q”",
       "naïve façade", "жук 漢字 かな", "😀 👩‍👩‍👧 é", "1234 5,678.90", "a b  c", "\x1c \x1d x", "<s> </s> <unk>", "tab\tend\t", "w" * 1500, "ab " * 900, " " * 40, "end \n"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    letters = "abcde  \n.,'" + "éß漢😀▁\t "
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(n)]
    return [*ODD, *made, made[0], made[0], None]


def documents(spark, values):
    ship(spark)
    rows = [(i, t, "clash", i) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n_a int").repartition(3)


# --- tokens ------------------------------------------------------------------


@pytest.mark.parametrize("special", [True, False])
def test_word_table_equals_the_library(special):
    with open(A, "rb") as file:
        tokens = byte_tokens.ByteTokens(file.read(), special)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = not special
    assert tokens.fast is not None
    table = byte_tokens.WordTable(tokens)
    table.MAX_WORDS = 50  # starts anew again and again
    values = [t for t in texts(200) if t is not None]
    got = [x.tolist() for group in byte_tokens.in_groups(values, 300) for x in table.encode(group)]
    assert got == [x.ids for x in library.encode_batch(values, add_special_tokens=False)]


# --- packing -----------------------------------------------------------------


def test_pieces_cover_every_id_once_and_windows_are_full(spark):
    values = [*texts(), "lorem ipsum " * 5000, "x " * 2047, "x " * 2048]
    docs = documents(spark, values)
    rows = packing.pack(docs, A, with_ids=True).collect()
    library = Tokenizer.from_file(A)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, t in enumerate(values):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == want
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert {p["doc_tokens"] for p in pieces} == {len(want)}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    steps = defaultdict(list)
    for key, pieces in sequences.items():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        total = sum(p["length"] for p in pieces)
        assert {(p["context"], p["step"]) for p in pieces} == {(total, pieces[0]["step"])} and total & (total - 1) == 0 and total <= 2048
        steps[pieces[0]["step"]].append(total)
    assert all(len(set(s)) == 1 and sum(s) <= packing.STEP_TOKENS for s in steps.values())
    whole = packing.sequences(packing.pack(docs, A, with_ids=True)).collect()
    assert len(whole) == len(sequences) and all(len(r["ids"]) == r["context"] for r in whole)


def test_long_windows_take_short_rests():
    import numpy as np

    packer = packing.Packer(0, (8, 4, 2), 16)
    for doc, n in enumerate((7, 6, 5, 3, 2, 1, 8, 16)):
        packer.add(doc, np.arange(n, dtype=np.int32))
    packer.pack(True)
    made = defaultdict(list)
    for doc, start, n, _, total, sequence, offset, context, step, _ in packer.steps(True):
        made[sequence].append((doc, n))
    assert [(0, 7), (5, 1)] in made.values() and [(1, 6), (4, 2)] in made.values() and [(2, 5), (3, 3)] in made.values()
    assert sorted(map(tuple, (x for v in made.values() for x in v if x[0] == 7))) == [(7, 8), (7, 8)]
    with pytest.raises(ValueError):
        packing.Packer(0, (6,), 16)


def test_packing_an_empty_table_and_blocks(spark, monkeypatch):
    docs = documents(spark, texts(5))
    assert packing.pack(docs.where("false"), A).count() == 0
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 50)
    assert packing.pack(docs, A).agg(F.sum("length")).first()[0] == packing.pack(docs, A).select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


# --- alignment ---------------------------------------------------------------


def test_galloping_equals_a_set_intersection():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randrange(0, 200))) for _ in range(2))
        x, y = alignment.common_ends(a, b)
        assert [a[i] for i in x] == [b[j] for j in y] == sorted(set(a) & set(b))


def plain_alignment(values):
    """All columns from whole texts, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_tokens.byte_of_letter()
    found = []
    for t in values:
        if not t:
            found.append(([], []))
            continue
        e = a.encode(" " + t, add_special_tokens=False)
        x = [(i, bytes(letters[c] for c in s)) for i, s in zip(e.ids, e.tokens)]
        names = [(i, b.id_to_piece(i)) for i in b.encode(t)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in names]
        whole = (" " + t).encode()
        same = b"".join(s for _, s in x) == whole == b"".join(s for _, s in y)
        found.append((x, y) if same else ([], []))
    links, groups = [], []
    for x, y in found:
        spans = []
        for side in (x, y):
            at, out = 0, []
            for i, s in side:
                out.append((i, at, at + len(s)))
                at += len(s)
            spans.append(out)
        links.append([(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e])
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        cut, parts = 0, []
        for end in ends:
            parts.append("|".join(",".join(str(i) for i, s, e in side if cut <= s and e <= end) for side in spans))
            cut = end
        groups.append(parts)
    n = Counter(p for ls in links for p in ls)
    top = {}
    for (i, j), c in n.items():
        top[j] = max(top.get(j, 0), c)
    return [
        (k, len(x), len(y), len(g), len(ls), sum(n[p] == top[p[1]] for p in ls), sum(n[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "")
        for k, ((x, y), ls, g) in enumerate(zip(found, links, groups))
    ]


@pytest.mark.parametrize("part, words", [(1_000_000, 600_000), (40, 30)])
def test_alignment_equals_a_plain_version(spark, monkeypatch, part, words):
    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    values = [t for t in texts(25) if t is None or len(t) < 3000]
    docs = documents(spark, values)
    if words < 100:
        monkeypatch.setattr(byte_tokens, "GROUP_CHARS", 100)
    got = alignment.align(docs, A, B)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == plain_alignment(values)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(documents(spark, ["a"]).where("false"), A, B).count() == 0


# --- ranked search -----------------------------------------------------------


def plain_ranking(docs, items, k):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: split.findall((t or "").translate(fold)) for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    n, total = len(words), sum(map(len, words.values()))
    counts = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts.items():
            m = 75 + 25 * len(words[i]) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split.findall((text or "").translate(fold)) if t in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("unit, block", [(1024, 4_000_000), (2, 40)])
def test_ranking_equals_a_plain_version(spark, monkeypatch, unit, block):
    monkeypatch.setattr(ranked, "UNIT_DOCS", unit)
    monkeypatch.setattr(ranked, "BLOCK_CHARS", block)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "GAMMA", "δέλτα", "x1", "É", "zeta", "rare", "漢字"]
    made = [" ".join(rng.choice(vocabulary[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    values = [None, "", "...", *made, made[0], made[0], made[0], "rare " * 3000]
    items = [(i, t) for i, t in enumerate([None, "", "rare alpha alpha", "beta-gamma É", "unknown", "δέλτα 漢字 zeta", "alpha", "alpha"])]
    docs = documents(spark, values)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = ranked.search(docs, asked, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_ranking(enumerate(values), items, 5)


def test_ranking_without_documents_or_items(spark):
    docs = documents(spark, ["a b", "c"])
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs.where("false"), asked).count() == 0
    assert ranked.search(docs, asked.where("false")).count() == 0
