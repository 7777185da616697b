"""Prompts and the answer hook: any user function from prompt to text, applied per partition with retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

BUSY = ("429", "RESOURCE_EXHAUSTED", "503", "UNAVAILABLE")
NOT_FOUND = "Informasi ini tidak ditemukan dalam dokumen yang diunggah."
NO_DOCUMENTS = "Maaf, tidak menemukan informasi yang relevan dalam dokumen."

TASKS = {
    "aggregation": "Compute the requested figure from the data below and name its source.",
    "comparison": "Compare the items asked about, using only the data below.",
    "explanation": "Explain, using only the documents below.",
    "general": "Answer from the documents below only.",
}


def prompt_kind(is_aggregation: Column, is_comparison: Column, is_explanation: Column, only_tables: Column) -> Column:
    """A figure is asked for only when tables were the sole source."""
    return (
        F.when(is_aggregation & only_tables, "aggregation").when(is_comparison, "comparison")
        .when(is_explanation, "explanation").otherwise("general")
    )


def prompt(kind: Column, context: Column, question: Column, has_conflicts: Column) -> Column:
    task = F
    for name, text in TASKS.items():
        task = task.when(kind == name, F.lit(text))
    note = F.when(has_conflicts & (kind == "aggregation"), "\nSources differ: prefer the table values.").otherwise("")
    return F.concat(
        task, note, F.lit("\n\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question,
        F.lit(f"\nIf nothing fits, say: {NOT_FOUND}\nAnswer in the language of the question:"),
    )


def with_answers(
    prompts: DataFrame, model: Callable[[str], str], max_retries: int = 6, base_delay: float = 15.0
) -> DataFrame:
    """Add ``answer``.  A busy model is asked again after a doubling wait; other errors become the answer text."""
    schema = T.StructType(prompts.schema.fields + [T.StructField("answer", T.StringType())])

    def run(frames):
        import time

        def ask(text):
            for attempt in range(max_retries + 1):
                try:
                    return model(text)
                except Exception as problem:  # noqa: BLE001
                    if attempt == max_retries or not any(mark in str(problem) for mark in BUSY):
                        return f"Generate error: {problem}"
                    time.sleep(base_delay * 2**attempt)

        for frame in frames:
            yield frame.assign(answer=[ask(p) for p in frame["prompt"]])

    return prompts.mapInPandas(run, schema)
