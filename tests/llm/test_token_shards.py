"""Documents of a batch are encoded, packed and read together, with the ids and in the format of each alone."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from voxloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    JSON = f.read()


def test_documents_are_packed_together_as_each_alone():
    rng = np.random.default_rng(4)
    sizes = np.array([0, 5, 1, 0, 4, 300, 3, 0])
    ranks = (10.0 ** rng.uniform(0, 9.6, sizes.sum())).astype(np.uint32)
    control, data, c, d = tokens.pack_documents(ranks, sizes)
    raw, at = b"", 0
    for k, n in enumerate(sizes):
        a, b = (int(c[k - 1]), int(d[k - 1])) if k else (0, 0)
        own = ranks[at : at + n]
        width = [1 if r < 1 << 8 else 2 if r < 1 << 16 else 3 if r < 1 << 24 else 4 for r in own.tolist()]
        assert data[b : d[k]] == b"".join(int(r).to_bytes(w, "little") for r, w in zip(own, width))
        codes = [w - 1 for w in width] + [0] * (-n % 4)
        assert control[a : c[k]] == bytes(sum(x << (2 * j) for j, x in enumerate(codes[q : q + 4])) for q in range(0, len(codes), 4))
        raw, at = raw + control[a : c[k]] + data[b : d[k]], at + n
    assert np.array_equal(tokens.unpack_documents(raw, sizes, np.diff(np.append(0, d))), ranks)
    assert not len(tokens.unpack_documents(b"", np.zeros(2, np.int64), np.zeros(2, np.int64)))


class Counted(dict):
    """A dictionary that counts how often it is asked."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_word_that_many_texts_have_is_looked_up_once():
    encoder = tokens.Encoder(JSON)
    texts = [f"w{i % 3} one two, three\nfour five" for i in range(900)]
    first = encoder.batch(texts)
    encoder.known = Counted(encoder.known)
    assert encoder.batch(texts) == first
    assert encoder.known.asked <= 16  # 3 first words and 5 others


def test_texts_of_all_kinds_together_encode_as_each_alone():
    encoder = tokens.Encoder(JSON)
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for letters in ("ab c\n'sé.,1", "ab c\n\0<|\t\x85　中") for _ in range(1500)]
    texts += ["a \0b", "\0", "\0a", "", " ", "a\n\nb c", "\na b", "a b\n", "a  b", "a <|endoftext|> b", "a b c"]
    rng.shuffle(texts)
    ids, ends = encoder.column(pa.array([None, *texts, None]))
    alone = [[], *([*x.ids] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)), []]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == alone
    assert [len(x) for x in encoder.column(pa.array([], pa.string()))] == [0, 0]


def test_zeros_in_texts_keep_their_ids(spark, tmp_path):
    texts = ["a \0b", "\0 \0a", "b"]
    tokens.encode_corpus(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, f"file://{tmp_path}/z")
    rows = sorted(tokens.read_corpus(spark, f"file://{tmp_path}/z").collect())
    assert [list(r.ids) for r in rows] == [[*tokens.Encoder(JSON).tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_batches_are_joined_until_they_reach_a_size():
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": ["x" * 100]}) for i in range(7)]
    got = list(tokens.gathered(iter(batches), 200))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1], [2, 3], [4, 5], [6]]
    assert list(tokens.gathered(iter([]), 200)) == []
