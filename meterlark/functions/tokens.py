"""Token counts.  Without an exact vocabulary a text counts as its UTF-8 bytes, the reference's fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_text(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def count_messages(messages: Column) -> Column:
    """Each message: 4, role, content and name; 2 more if there are any."""
    each = F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + 4 + count_text(m["role"]) + count_text(m["content"]) + count_text(m["name"]))
    return each + F.when(F.size(messages) > 0, 2).otherwise(0)


def count_tools(tools: Column) -> Column:
    """TOK5: bytes of a JSON text with sorted keys and a space after each comma and colon; other texts count as they are.

    A variant keeps an object's fields in the order of their names and writes them without spaces.
    """
    compact = F.to_json(F.try_parse_json(tools))
    outside = F.regexp_replace(compact, r'"(?:[^"\\]|\\.)*"', "")
    spaces = F.length(outside) - F.length(F.translate(outside, ",:", ""))
    return F.coalesce(F.octet_length(compact) + spaces, F.octet_length(tools), F.lit(0))


def count_chunks(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + count_text(c))


def part_texts(parts: Column) -> Column:
    """Text of a list of content parts (type, text): the text parts joined by a space."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), " ")


def exact_counter(path: str):
    """TOK1: a function column -> exact BPE count by an Arrow UDF, for a tokenizer file that is at hand on every executor.

    ``count_messages`` and the rules count bytes, as the reference does where no vocabulary is cached.
    """
    import pandas as pd

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count


def tokenizer_provenance(models: DataFrame, vocabularies: dict[str, str], model: str = "model") -> DataFrame:
    """TOK7: (model, encoding, method, confidence): exact where a model's encoding has a vocabulary file at hand, else the byte count.

    ``vocabularies``: model -> encoding, for encodings whose file is there.
    """
    known = F.create_map(*[F.lit(x) for pair in vocabularies.items() for x in pair]) if vocabularies else F.create_map().cast("map<string,string>")
    name = F.try_element_at(known, F.lower(model))
    exact = name.isNotNull()
    return models.select(F.col(model).alias("model"), F.coalesce(name, F.lit("utf8_bytes")).alias("encoding"), F.when(exact, "bpe").otherwise("utf8_byte_heuristic").alias("method"), F.when(exact, "exact").otherwise("low").alias("confidence"))
