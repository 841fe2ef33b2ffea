"""Columns with one form for visually identical text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from loomwake.llm import codepoints as C

_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ByteType())])


def _result(a: pa.Array, latin: bool) -> pa.StructArray:
    text, kinds = C.canonical_arrow(a, latin)
    return pa.StructArray.from_arrays([text.cast(pa.string()), pa.array(kinds.astype(np.int8))], ["text", "kinds"])


@arrow_udf(_RESULT)
def _canonical(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in texts:
        yield _result(a, False)


@arrow_udf(_RESULT)
def _skeleton(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in texts:
        yield _result(a, True)


def canonical(c: Column | str) -> Column:
    """Struct of the text in its one form and the kinds of variants it had (bits of ``KINDS``).

    The form is NFKC with these differences: spaces are the ordinary one, invisible characters
    are gone except the joiners and selectors inside emoji and the joiners of ordinary spelling
    in Indic and Arabic scripts, and words that mix Latin, Cyrillic and Greek letters are written
    in one script. Null stays null with no kinds, an empty text stays empty, texts of any length
    are handled in slices, repeated rows get equal results. Applying it twice changes nothing.
    """
    return _canonical(F.col(c) if isinstance(c, str) else c)


def host_form(c: Column | str) -> Column:
    """A host name without letter case, ordinary outer blanks, leading ``www.`` and final dot."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"\.$", "")


def host_skeleton(c: Column | str) -> Column:
    """What a host name looks like: one form, look-alike letters as Latin ones, no blanks."""
    shown = F.regexp_replace(F.replace(_skeleton(F.col(c) if isinstance(c, str) else c)["text"], F.lit("。"), F.lit(".")), r"\s+", "")
    return host_form(shown)


def with_canonical(df: DataFrame, column: str, text: str = "canonical_text", kinds: str = "variant_kinds") -> DataFrame:
    """``df`` with the one form of ``column`` and its kinds of variants; columns of these names are replaced."""
    one = canonical(column)  # evaluated once for both
    return df.withColumns({text: one["text"], kinds: one["kinds"]})


def kind_names(c: Column | str) -> Column:
    """Names of the kinds in a bit set."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_compact(F.array(*[F.when(c.bitwiseAND(F.lit(bit)) > 0, F.lit(name)) for name, bit in C.KINDS.items()]))


__all__ = ["canonical", "host_form", "host_skeleton", "kind_names", "with_canonical"]
