"""Archives and token files: round trips, commits after a dead driver, and readers that trust nothing."""

import gzip
import io
import random
import shutil
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import files, queries, tokens, warc

SF = "/root/testdata/sf0.001"


def pages_of(spark, n=40):
    return spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i % 30} " + "x" * i) for i in range(n)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("archive")
    warc.write(pages_of(spark), f"file://{top}/a", roll_bytes=4000)
    return top / "a"


def fails(spark, folder, reader=warc.read):
    with pytest.raises(Exception) as caught:  # noqa: B017, PT011
        reader(spark, f"file://{folder}").count()
    return str(caught.value)


def test_lost_member(spark, archive, tmp_path):
    own = shutil.copytree(archive, tmp_path / "a")
    assert warc.read(spark, f"file://{own}").count() == 40
    last = sorted(own.glob("*.warc.gz"))[-1]
    data = last.read_bytes()
    last.write_bytes(data[: data.rindex(b"\x1f\x8b\x08\x00\x00\x00\x00\x00")])
    assert "isn't the file that the manifest names" in fails(spark, own)


def test_swapped_and_missing_files(spark, archive, tmp_path):
    own = shutil.copytree(archive, tmp_path / "a")
    first, second = sorted(own.glob("*.warc.gz"))[:2]
    a, b = first.read_bytes(), second.read_bytes()
    first.write_bytes(b)
    second.write_bytes(a)
    assert "isn't the file that the manifest names" in fails(spark, own)
    first.write_bytes(a)
    second.unlink()
    assert second.name in fails(spark, own)
    shutil.rmtree(own / "manifest")
    assert "no committed manifest" in fails(spark, own)


def test_number_of_records(archive):
    row = {"name": "x", "n_bytes": 3, "sha1": files.hashlib.sha1(b"abc").hexdigest(), "n_records": 2}
    files.Checked(io.BytesIO(b"abc"), row).close(2)
    with pytest.raises(ValueError, match="1 records, 2 expected"):
        files.Checked(io.BytesIO(b"abc"), row).close(1)


def died(spark, folder, keep=lambda name: True):
    """The folder of a write whose driver died while it renamed: a whole first manifest, and some files still under their temporary names."""
    schema = files.MANIFEST
    rows = spark.read.schema(schema).parquet(f"file://{folder}/manifest").collect()
    spark.createDataFrame(rows, schema).write.parquet(f"file://{folder}/_manifest-temporary")
    shutil.rmtree(folder / "manifest")
    (folder / "_temporary").mkdir()
    for r in rows:
        if not keep(r["name"]):
            shutil.move(folder / r["name"], folder / "_temporary" / r["temporary"])


def test_write_goes_on_after_a_dead_driver(spark, archive, tmp_path):
    own = shutil.copytree(archive, tmp_path / "a")
    names = sorted(f.name for f in own.glob("*.warc.gz"))
    died(spark, own, lambda name: name in names[::2])
    (own / "manifest").mkdir()  # begun, not committed
    made = warc.write(pages_of(spark), f"file://{own}", roll_bytes=4000)
    assert {r["name"] for r in made.collect()} == set(names) and not (own / "_temporary").exists() and not (own / "_manifest-temporary").exists()
    assert warc.read(spark, f"file://{own}").count() == 40
    with pytest.raises(FileExistsError):
        warc.write(pages_of(spark), f"file://{own}")


def test_stale_final_file(spark, archive, tmp_path):
    own = shutil.copytree(archive, tmp_path / "a")
    names = sorted(f.name for f in own.glob("*.warc.gz"))
    died(spark, own, lambda name: name in names[:1])
    (own / names[0]).write_bytes(gzip.compress(b"left by another write"))
    with pytest.raises(Exception, match="isn't the file that the manifest names"):
        warc.write(pages_of(spark), f"file://{own}", roll_bytes=4000)
    assert "no committed manifest" in fails(spark, own)


def test_first_job_that_died_begins_anew(spark, tmp_path):
    own = tmp_path / "a"
    (own / "_manifest-temporary").mkdir(parents=True)
    (own / "_temporary").mkdir()
    (own / "_temporary" / "shard-000000-00000.warc.gz.dead").write_bytes(b"part of a file")
    warc.write(pages_of(spark, 5), f"file://{own}")
    assert warc.read(spark, f"file://{own}").count() == 5 and not (own / "_temporary").exists()


def test_ids_that_are_no_numbers(spark, tmp_path):
    odd = pages_of(spark, 3).withColumn("page_id", F.lit("one"))
    with pytest.raises(TypeError, match="page_id"):
        warc.write(odd, f"file://{tmp_path}/a")
    with pytest.raises(TypeError, match="page_id"):
        tokens.write(odd, f"file://{tmp_path}/b", "page_id", "html")


# --- token ids


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 15, 16, 17, 24, 31, 32])
def test_fixed_width(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1001):
        ids = rng.integers(0, 1 << bits, n).astype("<u4")
        data = tokens.pack(ids, bits)
        assert len(data) == (n * bits + 7) // 8
        assert (tokens.unpack(data, bits, n) == ids).all()
        for skip in (0, n // 2):
            assert (tokens.unpack(data, bits, n - skip, skip) == ids[skip:]).all()
    if bits < 32:
        with pytest.raises(ValueError, match="doesn't fit"):
            tokens.pack(np.array([1 << bits]), bits)
    with pytest.raises(ValueError, match="cut short"):
        tokens.unpack(b"", bits, 1)


def test_bits_of_vocabularies():
    assert [tokens.bits_of(n) for n in (1, 2, 3, 256, 257, 32_000, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]


class Held(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def made_file(docs, bits=13, block=64):
    data = io.BytesIO()
    out = tokens.TokenWriter(lambda b, n: data.write(b), bits, block)
    for key, ids in docs:
        out.add(key, ids)
    out.close()
    return data.getvalue()


def test_random_access_and_damage():
    rng = np.random.default_rng(1)
    docs = [(i - 3 if i else None, rng.integers(0, 1 << 13, rng.integers(0, 200)).astype("<u4")) for i in range(50)]
    data = made_file(docs)
    file = tokens.TokenFile(Held(data))
    every = np.concatenate([ids for _, ids in docs])
    assert file.n_ids == len(every) and [None if z else int(k) for k, z in zip(file.docs, file.nulls, strict=True)] == [k for k, _ in docs]
    for k, (_, ids) in enumerate(docs):
        assert (file.document(k) == ids).all()
    for _ in range(100):
        a, b = sorted(rng.integers(0, len(every) + 1, 2).tolist())
        assert (file.ids(a, b) == every[a:b]).all()
    with pytest.raises(IndexError):
        file.ids(0, len(every) + 1)
    # One changed byte, anywhere, is noticed by whoever reads it, and by nobody else.
    hurt = bytearray(data)
    hurt[int(file.offsets[3]) + 5] ^= 1
    damaged = tokens.TokenFile(Held(bytes(hurt)))
    assert (damaged.ids(0, 192) == every[:192]).all()
    with pytest.raises(ValueError, match="block 3"):
        damaged.ids(190, 200)
    for broken in (data[:-1], data[: len(data) // 2], b"", data[:-60] + b"x" + data[-59:]):
        with pytest.raises(ValueError, match="token ids"):
            tokens.TokenFile(Held(broken))
    assert tokens.TokenFile(Held(made_file([]))).n_docs == 0


def exact():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_pieces_give_the_ids_of_whole_texts():
    """Texts of all planes, marks, blanks, contractions and special tokens; the memory for pieces is small, so it is often forgotten."""
    rng, plain = random.Random(5), exact()
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r\x0b\x0c\x1c\x85  　"), lambda: chr(rng.randrange(0x80, 0x250)), lambda: chr(rng.randrange(0x250, 0xD800)), lambda: rng.choice(["'s", "'T", "'re", "ll'd", "0", "9.", "²", "¼", "ª"]), lambda: chr(rng.randrange(0x300, 0x370)), lambda: chr(rng.randrange(0x400, 0x460)), lambda: chr(rng.randrange(0x2010, 0x2028)), lambda: chr(rng.randrange(0x4E00, 0x9FA6)), lambda: chr(rng.randrange(0, 32)), lambda: chr(rng.randrange(97, 123)), lambda: rng.choice(["<|endoftext|>", "a", " "])]
    texts: list = [None, ""]
    for _ in range(4000):
        some = rng.sample(kinds, rng.randrange(1, 4))
        texts.append("".join(rng.choice(some)() for _ in range(rng.randrange(0, 60))))
    encode = tokens.Encoder("word_bpe_49k", remembered=50)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encode(pa.array(texts[at : at + 100], pa.string()), 1), strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1], text


def test_token_files_of_documents(spark):
    plain, start = exact(), 0
    got = queries.op12_token_ids(spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    for r, d in zip(got, docs, strict=True):
        ids = np.array([*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path):
    rows = [(None, "no id"), (None, None), (5, None), (5, "twice"), (5, "twice"), (-1, ""), (9, "word " * 20000), (7, "ё́ <|endoftext|> ’s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    listed = tokens.write(docs, f"file://{tmp_path}/a", roll_bytes=200, block=16).collect()
    assert len(listed) > 1 and sum(r["n_records"] for r in listed) == len(rows)
    got = tokens.read(spark, f"file://{tmp_path}/a", ids=True).orderBy("start").collect()
    plain = exact()
    want = sorted(((d, [*plain.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert tokens.write(docs.where("false"), f"file://{tmp_path}/b").count() == 0 and tokens.read(spark, f"file://{tmp_path}/b").count() == 0
    # A reader of another file in this one's place, or of a cut one.
    first, second = sorted(Path(tmp_path / "a").glob("*.ids"))[:2]
    first.write_bytes(second.read_bytes())
    assert "isn't the file" in fails(spark, tmp_path / "a", tokens.read)
