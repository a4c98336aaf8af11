import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from thermoline.llm import records as r
from thermoline.llm import textkit as tk

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def brute(rows):
    out, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64_intdigest(x[1].encode(), seed=42)).astype(np.int64))):
        ids = [*PLAIN.encode(t, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(docs, rows, folder):
    manifest = r.write_records(docs, folder, PATH, files=4)
    assert sorted(map(tuple, r.read_records(manifest).collect()), key=str) == sorted(brute(rows), key=str)
    return manifest


def test_chunks_have_the_ids_of_the_text():
    rng = random.Random(3)
    pieces = ["a", "Word", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "é", "ß", "日本", "\U0001f600", "'s", "<|endoftext|>", "12", ".", "!?", "\r\n", "\x1c", "à"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, sizes = r.ChunkEncoder(PATH).encode(*tk.utf8(pa.array(texts)))
    ends = np.cumsum(sizes)
    for t, e, n in zip(texts, ends, sizes, strict=True):
        assert ids[e - n : e].tolist() == PLAIN.encode(t, add_special_tokens=False).ids, repr(t)


def test_matches_brute_force(spark, real, tmp_path):
    rows = [(x.doc_id, x.text) for x in real.collect()]
    manifest = check(real, rows, f"file://{tmp_path}/records")
    shuffled = r.shuffled_ids(spark, manifest, 7).collect()
    assert sorted(x.doc_id for x in shuffled) == sorted(i for i, _ in rows)
    assert [x.doc_id for x in shuffled] != sorted(i for i, _ in rows)
    texts = dict(rows)
    assert all(x.ids == [*PLAIN.encode(texts[x.doc_id], add_special_tokens=False).ids, 2] for x in shuffled)
    assert [x.place for x in shuffled] == sorted(x.place for x in shuffled)


def test_odd_rows(table, odd, tmp_path):
    check(table(odd), odd, f"file://{tmp_path}/a")
    check(table([]), [], f"file://{tmp_path}/b")


def test_one_id_fills_many_files(table, tmp_path):
    rows = [(None, f"text {k % 7}") for k in range(4000)] + [(-(2**63), "least")] + [(5, "same")] * 4000
    manifest = check(table(rows), rows, f"file://{tmp_path}/a")
    assert max(r.n_records for r in manifest.collect()) < 4000


def test_damage_is_found(table, tmp_path):
    manifest = check(table([(1, "some text"), (2, "more")]), [(1, "some text"), (2, "more")], f"file://{tmp_path}/a")
    fs, path = pafs.FileSystem.from_uri(manifest.first()["path"])
    with open(f"{path}.rec", "r+b") as file:
        file.seek(25)
        file.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        r.read_records(manifest).collect()


def test_ids_go_by_bytes_where_polynomials_collide(table, tmp_path):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    check(table(rows), rows, f"file://{tmp_path}/a")
