"""Token counts with a whole-token shortcut.

For a BPE model whose vocabulary has no piece that continues after a blank, no
merge crosses the start of a run of blanks, so the text falls into independent
pre-tokens: blanks and what follows them. :func:`prove` checks this offline on
the vocabulary, and finds which vocabulary strings encode alone as one token;
pre-tokens that match one are counted directly. Only the others are merged by
the library, once each while they stay in a bounded memo. A model for which the
proof fails has its texts encoded whole. The plan is map-only; the model's bytes
and proof travel in a broadcast bounded by the vocabulary file.

Defined results: null text counts as empty (0 bytes, 0 tokens); nothing is
truncated, however long; repeated rows, and rows with a null id, are counted
alike; an empty table gives an empty result; extra columns pass through, but for
one named as the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
MEMO_WORDS, MEMO_LENGTH = 200_000, 48
#: The mark that the library puts for a blank.
MARK = "▁"


class Model:
    """Bytes of a vocabulary file, with what was proved about it."""

    def __init__(self, data: bytes, kind: str, whole: frozenset[str] | None):
        self.data, self.kind, self.whole, self._live = data, kind, whole, None

    def __getstate__(self):
        return {"data": self.data, "kind": self.kind, "whole": self.whole, "_live": None}

    def live(self):
        if self._live is None:
            self._live = (load(self.data, self.kind), dict.fromkeys(self.whole or (), 1))
        return self._live


def load(data: bytes, kind: str):
    if kind == "model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=data)
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.no_truncation()
    t.no_padding()
    return t


def encode_counts(lib, kind: str, texts: list[str]) -> list[int]:
    if kind == "model":
        return [len(x) for x in lib.encode(texts, num_threads=1)] if texts else []
    return [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)] if texts else []


def prove(path: str) -> Model:
    """Read a vocabulary file and find the strings that encode alone as one token (None: no proof)."""
    with open(path, "rb") as f:
        data = f.read()
    kind = "model" if path.endswith(".model") else "json"
    if kind != "model":
        return Model(data, kind, None)
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(data)
    n = spec.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    bpe = spec.trainer_spec.model_type == pb.TrainerSpec.ModelType.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
    user = any(p.type == pb.ModelProto.SentencePiece.Type.USER_DEFINED for p in spec.pieces)
    crossing = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
    if not (plain and bpe) or user or crossing:
        return Model(data, kind, None)
    words = [p.piece[1:] for p in spec.pieces if p.piece.startswith(MARK) and len(p.piece) > 1 and p.piece[1] != MARK]
    lib = load(data, kind)
    whole = frozenset(w for w, k in zip(words, encode_counts(lib, kind, words)) if k == 1)
    return Model(data, kind, whole)


def pre_tokens(text: str) -> tuple[list[str], int]:
    """Words after their first blank (the library adds one in front), and how many trailing blanks are left."""
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts, 0
    out, blanks = [], 0
    for p in parts:
        if p:
            out.append(" " * blanks + p)
            blanks = 0
        else:
            blanks += 1
    return out, blanks


def count_texts(texts: list[str | None], model: Model) -> list[int]:
    lib, memo = model.live()
    if model.whole is None:
        return encode_counts(lib, model.kind, [t or "" for t in texts])
    out = []
    for t in texts:
        if not t:
            out.append(0)
            continue
        parts, trailing = pre_tokens(t)
        n = 0
        if trailing:
            n = 1 if trailing == 1 else len(lib.encode(" " * (trailing - 1)))
        new = [p for p in set(parts) if p not in memo]
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            memo.update(dict.fromkeys(model.whole, 1))
            new = [p for p in set(parts) if p not in memo]
        fresh = dict(zip(new, encode_counts(lib, model.kind, new)))
        n += sum(memo[p] if p in memo else fresh[p] for p in parts)
        memo.update((p, k) for p, k in fresh.items() if len(p) <= MEMO_LENGTH)
        out.append(n)
    return out


def count(docs: DataFrame, path: str, *, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(prove(path))

    @F.arrow_udf("long")
    def tokens(texts):
        import pyarrow as pa

        return pa.array(count_texts(texts.to_pylist(), shared.value), type=pa.int64())

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], tokens(F.col(f"`{text}`")).alias(out))


def query(docs: DataFrame, path: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    n = count(docs.select("doc_id", "text"), path)
    return n.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
