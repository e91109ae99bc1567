"""Size counters (U2): the built-in one, and the Python crossing for tokenizers of the user."""
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def regex_counter(pattern=r"[A-Za-z0-9]+"):
    """A vectorised size counter; any text -> int callable can be wrapped the same way."""
    rx = re.compile(pattern)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda s: sum(1 for _ in rx.finditer(s))).astype("int64")
    return count


def builtin_counter(pattern=r"[A-Za-z0-9]+"):
    """The default size counter, a Column function on the JVM."""
    return lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("bigint")
