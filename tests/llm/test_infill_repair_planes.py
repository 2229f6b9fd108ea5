import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayframe.llm import infill, planes, queries, repair
from assayframe.llm._spark import salted

LONG = "lorem ipsum dôlor \U0001f600 " * 20_000
ODD = [(1, "The quick brown fox"), (2, "The quick brown fox"), (2, "The quick brown fox"), (3, None), (4, ""), (5, " \n\t "), (7, LONG), (8, LONG), (9, "été \U0001f600" * 50), (None, "no number"), (10, "holds <S> itself"), (11, "ends in <"), (12, "<S><P"), (13, "x" * 70_000), (14, "á ́b\xa0c\x1cd\x0be <|endoftext|> İstanbul ΟΔΟΣ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of odd kinds, with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("key", "n", "k1", "salt", "form", "a", "m", "h", "part", "start", "ids", "place"):
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


# fill in the middle


def cut(key, text, rate=90, spm=20):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_boundaries_by_brute_force(monkeypatch):
    rng = random.Random(5)
    for size in (infill.SLICE, 7):
        monkeypatch.setattr(infill, "SLICE", size)
        for alphabet in ("ab ", "é", "\U0001f600", "aé€\U0001f600"):
            for n in (0, 1, 2, 63, 64, 600, 5000):
                text = "".join(rng.choices(alphabet, k=n))
                held = infill.Boundaries(text.encode())
                at = np.cumsum([0, *[len(c.encode()) for c in text]]).tolist()
                assert held.n == n and [held.select(i) for i in range(n + 1)] == at
                assert 8 * (len(held.high) + len(held.low)) <= 4 * (n + 1) + 16  # a few bits a code point


@pytest.mark.parametrize(("rate", "spm"), [(90, 20), (100, 100), (100, 0), (0, 50)])
def test_infilled_by_definition(spark, odd, rate, spm):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for table in (odd, docs):
        rows = infill.infilled(table, rate=rate, spm=spm).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert all(r.back == r.output if r.form == "plain" else True for r in rows)
        key = lambda r: tuple(map(repr, r))
        assert sorted([tuple(r)[:-1] for r in rows], key=key) == sorted([cut(r.doc_id, r.text or "", rate, spm) for r in table.collect()], key=key)
        texts = sorted((repr(r.doc_id), r.back) for r in rows)
        assert texts == sorted((repr(r.doc_id), r.text or "") for r in table.collect())
    assert infill.infilled(odd.where("false")).count() == 0


def test_infill_index_once_a_text(spark, monkeypatch):
    """Half of all rows hold one text: it is dealt out, and each task lists its boundaries once."""
    made = []
    real = infill.Boundaries
    monkeypatch.setattr(infill, "Boundaries", lambda t: made.append(t) or real(t))
    batch = lambda rows: pa.RecordBatch.from_pylist([{"key": i, "k1": k, "k2": k, "n": len(t), "form": "psm", "a": 1, "b": 2, "text": t} for i, (k, t) in enumerate(rows)])
    out = list(infill._joined([batch([(1, "same")] * 3 + [(2, "one"), (2, "two"), (2, "one")]), batch([(2, "two"), (3, "same")])]))
    assert [x["output"] for b in out for x in b.to_pylist()] == [f"<P>{t[0]}<S>{t[2:]}<M>{t[1]}" for t in ["same"] * 3 + ["one", "two", "one", "two", "same"]]
    assert made == [b"same", b"one", b"two", b"same"]  # texts of one hash are told apart by content
    monkeypatch.undo()

    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "one text of all").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    dealt = salted(hot.select(F.xxhash64("text").alias("k"), "doc_id"), ["k"])
    sizes = [r["count"] for r in dealt.groupBy("k", "salt").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 4000 // 16 + 4
    assert infill.infilled(hot).count() == 4000


def test_infill_query_restores(spark):
    found = {r.doc_id: r for r in queries.op11_infill_index(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {k: r.restored_sha256 for k, r in found.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


# conversations


def cheapest(symbols):
    """All edits of a signature, one by one: least (cost, audit) that gives a legal order of roles."""
    best, n = None, len(symbols)
    gaps = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=n):
        if any(x == "d" and e != "D" for x, e in zip(symbols, edits, strict=True)):
            continue
        for inserted in itertools.product(gaps, repeat=n + 1):
            audit = inserted[0] + "".join(e + i for e, i in zip(edits, inserted[1:], strict=True))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for x, e in zip(symbols, edits, strict=True) if x.isupper() and e != "D")
            if best and (cost, audit) >= best:
                continue
            options = [""]
            left = iter(symbols)
            for e in audit:
                x = "" if e == "I" else next(left).lower()
                roles = {"K": [x], "R": ["u", "a"], "I": ["u", "a"], "D": [""]}[e]
                options = [o + r for o in options for r in roles]
            if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                best = (cost, audit)
    return best


def test_repairs_by_brute_force():
    every = [""] + ["".join(x) for k in (1, 2, 3) for x in itertools.product("suaxUAd", repeat=k)]
    rng = random.Random(3)
    every += ["".join(rng.choices("suaxSUAXd", k=4)) for _ in range(60)]
    every = sorted(set(every))
    found = list(repair.solved(every))
    assert [f[0] for f in found] == every
    for signature, cost, audit in found:
        assert (cost, audit) == cheapest(signature), signature


def test_layers_are_shared_by_prefix(monkeypatch):
    made = []
    real = repair.layer
    monkeypatch.setattr(repair, "layer", lambda before, x: made.append(x) or real(before, x))
    every = sorted({"".join(x) for x in itertools.product("ua", repeat=6)} | {"uad", "u"})
    prefixes = {s[: i + 1] for s in every for i in range(len(s))}
    assert len(list(repair.solved(every))) == len(every) and len(made) == len(prefixes)


def by_hand(rows):
    """A conversation's counts and repair, rows being (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, counts, symbols = [], {"blank": 0, "duplicate": 0, "truncated": 0}, ""
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.append((role, text))
        if fault:
            counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return symbols, gaps, counts, illegal, [(r, t) for _, r, t in rows]


def damage(conv, turn, role, text):
    s = lambda x: " " if x is None else str(x)
    code = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
    role, text = s(role), s(text)
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def repaired_by_hand(rows, audit):
    out, left = [], iter(rows)
    for e in audit:
        role, text = (None, "") if e == "I" else next(left)
        if e == "K":
            out.append((role, text))
        elif e != "D":
            out.append(("user" if not out or out[-1][0][:1] != "u" else "assistant", text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def test_repair_query_by_hand(spark, tmp_path):
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    more = [(900, 0, "user", "One?"), (900, 0, "user", "One?"), (900, None, "assistant", "Two."), (901, None, None, None), (902, 3, "user", "Hi."), (902, 9, "assistant", "Yes."), (None, 0, "user", "A."), (None, 1, "assistant", "B."), (903, 1, "tool", "Out"), (904, 0, "", "x.")]
    more += [(1000 + i, 0, "user", "Same.") for i in range(300)]  # many conversations of one signature
    more += [(2000, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." if i % 7 else f"Turn {i}") for i in range(700)]
    schema = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame(real + more, schema).withColumn("rows", F.lit("x")).withColumn("signature", F.lit("y")).withColumn("fault", F.lit("z")).withColumn("cost", F.lit("w"))
    odd.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.op12_trie_repair(spark, str(tmp_path)).collect()}
    conversations = {}
    for conv, turn, role, text in real + more:
        conversations.setdefault(conv, []).extend(damage(conv, turn, role, text))
    assert set(found) == set(conversations)
    answers = {s: (c, a) for s, c, a in repair.solved(sorted({by_hand(r)[0] for r in conversations.values()}))}
    for conv, rows in conversations.items():
        symbols, gaps, counts, illegal, plain = by_hand(rows)
        cost, audit = answers[symbols]
        if len(symbols) <= 4:
            assert (cost, audit) == cheapest(symbols)
        text = "\n".join(f"{r}:{t}" for r, t in repaired_by_hand(plain, audit))
        r = found[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, *counts.values(), illegal, cost, audit), conv
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert repair.repaired(odd.where("false")).count() == 0


# ids


def ids_of(text, tokenizer):
    return [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_gives_the_ids_of_whole_texts(spark, name, monkeypatch):
    path = public_tokenizers.path(name)
    whole, encoder = Tokenizer.from_file(path), planes.Encoder(path, 2)
    assert encoder.by_word == (name == "word_bpe_49k.json")
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [t or "" for _, t in ODD]
    for known in (planes.KNOWN, 50):
        monkeypatch.setattr(planes, "KNOWN", known)
        got = [x for at in range(0, len(texts), 40) for x in encoder.encoded(pa.array(texts[at : at + 40]))]
        assert encoder.encoded(pa.array(texts).slice(3, 2)) == got[3:5]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t, whole) for t in texts]


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip_and_spans(bits):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.zeros(9, "<u4"), rng.integers(0, 2**32, 1003).astype("<u4"), rng.integers(0, 49408, 777).astype("<u4")):
        kept = planes.split_planes(ids, bits)
        assert len(kept) == 32 // bits and (planes.joined_planes(kept, len(ids), bits) == ids).all()
    writer = planes.Writer(3, bits, chunk=100)
    docs = [(None if i == 0 else i, rng.integers(0, 49408, int(rng.integers(1, 40)) if i != 5 else 1234).astype("<u4")) for i in range(60)]
    for k, ids in docs:
        writer.add(k, ids.tobytes())
    data = writer.close()
    writer.add(99, b"\1\0\0\0")
    second = planes.File(writer.close() + b"\n")
    every = np.concatenate([x for _, x in docs])
    assert (second.part, second.file, second.before, second.ids) == (3, 1, len(every), 1)
    held = planes.File(data + b"\n")
    assert [(k, np.frombuffer(x, "<u4").tolist()) for k, _, x in held.rows()] == [(k, x.tolist()) for k, x in docs]
    assert [p for _, p, _ in held.rows()] == (np.cumsum([len(x) for _, x in docs]) - [len(x) for _, x in docs]).tolist()
    for a, b in ((0, 0), (0, 1), (99, 101), (250, 999), (len(every) - 3, len(every))):
        part = planes.File(data)
        assert part.span(a, b).tolist() == every[a:b].tolist() and part.opened <= (b - a) // 100 + 2
    damaged = bytearray(data)
    damaged[planes.ENTRY.size] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstandard's or the checksum's
        planes.File(bytes(damaged)).block(0)
    with pytest.raises(ValueError, match="planes"):
        planes.File(b"x" * 200)


def test_id_files(spark, odd, tmp_path, monkeypatch):
    whole = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    for k, table in enumerate((odd, spark.read.parquet(f"{DATA}/documents.parquet"))):
        planes.write(table, f"{tmp_path}/{k}", path, 2)
        got = sorted(planes.read(spark, f"{tmp_path}/{k}").collect(), key=lambda r: r.start)
        assert [repr(r.doc_id) for r in got] == [repr(r.doc_id) for r in sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))]
        start = 0
        for r in got:
            assert r.start == start and r.n_tokens == len(r.ids) // 4
            start += r.n_tokens
        expect = sorted((repr(r.doc_id), ids_of(r.text or "", whole)) for r in table.collect())
        assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == expect
    planes.write(odd.where("false"), f"{tmp_path}/none", path, 2)
    assert planes.read(spark, f"{tmp_path}/none").count() == 0


def test_id_query(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expect = 0, []
    for r in sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = ids_of(r.text or "", whole)
        expect.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op13_id_planes(spark, DATA).collect()) == expect
