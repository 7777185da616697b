"""Text to vector: a built-in hashed bag of words, or any user function over batches of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.words import let, words


def hashed_buckets(c: Column, dim: int) -> Column:
    """Bucket number of every word, from the first four hexadecimal digits of its md5."""
    return F.transform(
        words(c),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim),
    )


def hashed_vector(c: Column, dim: int) -> Column:
    """Unit length counts of the bucket numbers, counted inside the row, so that no list of words leaves it; no text is no words."""
    # with every number once more, the runs of the sorted list are the counts in order, each larger by one
    numbers = F.concat(F.coalesce(hashed_buckets(c, dim), F.array().cast("array<int>")), F.array(*[F.lit(i) for i in range(dim)]))

    def counts(sorted_numbers: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(sorted_numbers)), lambda i: (i == 1) | (F.get(sorted_numbers, i - 1) != F.get(sorted_numbers, i - 2)))
        return let(starts, lambda s: F.transform(
            s, lambda at, k: (F.coalesce(F.get(s, k + 1), F.size(sorted_numbers) + 1) - at - 1).cast("double")))

    return let(let(F.sort_array(numbers), counts), unit)


def with_vectors(df: DataFrame, embed: Callable[[list[str]], list], text: str = "text", out: str = "vec") -> DataFrame:
    """Apply a user model: ``embed`` gets a batch of texts and returns one list of numbers per text."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            if len(frame):
                vectors = [[float(x) for x in v] for v in embed(frame[text].tolist())]
                yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def unit(c: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return let(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))
