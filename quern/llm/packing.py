"""Items of varying length into containers of fixed capacity, first-fit decreasing.

Texts are measured in tokens of a public tokenizer; what exceeds a capacity is
cut into full pieces and a rest. All pieces are spread over randomised groups of
bounded size, and each group is filled independently by first-fit decreasing, the first container with room being found through a
tournament tree of the remaining capacities.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import durable
from quern.sources.tables import spread

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces of a group, about.
GROUP = 8192
# Spellings of language codes that aren't prefixes of the code itself.
LANGUAGES = {"jp": "ja", "jpn": "ja", "ger": "de", "deu": "de", "eng": "en", "chi": "zh", "zho": "zh", "cn": "zh", "fre": "fr", "fra": "fr", "spa": "es", "kor": "ko", "kr": "ko", "rus": "ru", "hin": "hi"}


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: the parameter, QUERN_VOCABULARY, or that of the installed tokenizer files."""
    if path or os.environ.get("QUERN_VOCABULARY"):
        return path or os.environ["QUERN_VOCABULARY"]
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


class TokenCounter:
    """Exact token counts; the count of each pre-token is kept, as texts repeat them."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(vocabulary_path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(piece) <= 32:
                    if len(known) > 500_000:
                        known.clear()
                    known[piece] = n
            total += n
        return total


#: Key of containers that take documents of any language.
ANY = "*"


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, lang, n_tokens) of every text that is neither null nor empty, measured whole."""

    def run(batches):
        count = TokenCounter(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "n_tokens": [count(t) for t in batch["text"]]})

    rows = spread(documents.where(F.length("text") > 0).select("doc_id", "lang", "text"), "doc_id")
    return rows.mapInPandas(run, "doc_id long, lang string, n_tokens int")


def language(lang: Column) -> Column:
    """Two-letter code of a language value in any case, with or without a region."""
    base = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, base), base)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of each size, sizes in falling order; none may exceed the capacity.

    The tree holds the largest remaining room below each node, so the leftmost
    container with room is reached in one descent.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out.append(node - leaves)
        left = room[node] - size
        room[node] = left
        node //= 2
        while node:
            a, b = room[2 * node], room[2 * node + 1]
            best = a if a > b else b
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def fill_containers(documents: DataFrame, specs: DataFrame, path: str | None = None, group: int = GROUP) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, first_token, n_tokens).

    A spec with a language takes documents of that language in any spelling, a
    null language takes all. Null and empty texts fill nothing; specs without
    a positive capacity give no rows; documents listed twice are filled twice.
    """
    counted = durable(token_counts(documents, path).select("doc_id", language(F.col("lang")).alias("lang"), "n_tokens"))
    salts = 16  # a language, or the documents of any, may be a third of all rows or more
    usable = specs.where(F.col("capacity_tokens") > 0).select("spec_id", "capacity_tokens", F.coalesce(language(F.col("lang")), F.lit(ANY)).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    keys = F.array_compact(F.array(F.lit(ANY), "lang"))
    wanted = counted.select("doc_id", "n_tokens", F.explode(keys).alias("_key"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"))
    pieces = wanted.join(usable, ["_key", "_salt"])
    cap, n = F.col("capacity_tokens"), F.col("n_tokens")
    pieces = pieces.select("spec_id", "capacity_tokens", "doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), n - 1, cap)).alias("piece_no", "first_token"))
    pieces = pieces.select("spec_id", "capacity_tokens", "doc_id", "piece_no", "first_token", F.least(cap, n - F.col("first_token")).alias("n_tokens"))
    groups = pieces.groupBy("spec_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group)).cast("long").alias("groups"))
    grouped = pieces.join(groups, "spec_id").withColumn("grp", F.pmod(F.xxhash64(F.lit(17), "spec_id", "doc_id", "piece_no"), F.col("groups")))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True])
        bins = first_fit_decreasing(frame["n_tokens"].tolist(), int(frame["capacity_tokens"].iloc[0]))
        spec, grp = frame["spec_id"].iloc[0], frame["grp"].iloc[0]
        return frame.assign(container_id=[f"{spec}-{grp}-{b}" for b in bins])[["spec_id", "container_id", "doc_id", "piece_no", "first_token", "n_tokens"]]

    return grouped.groupBy("spec_id", "grp").applyInPandas(fill, "spec_id int, container_id string, doc_id long, piece_no int, first_token int, n_tokens int")


def fill_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, pieces, containers, tokens, fill): fill is the share of all containers' room that is used."""
    each = filled.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"))
    total = each.groupBy("spec_id").agg(F.sum("p").alias("pieces"), F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    room = F.broadcast(specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens")))
    return total.join(room, "spec_id").select("spec_id", "pieces", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
