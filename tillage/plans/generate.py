"""Text generation through a user-supplied batch function (X2) and translation with one
checked retry (X3). The generator is injected (no network client is shipped); each task
calls it on bounded batches, and a failure becomes text in the row, never an exception."""
from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.text import is_in_language, translate_prompt
from tillage.session import cut_lineage


def generate_text(df: DataFrame, prompt_col: str, generator: Callable[[list], list], out_col: str = "generated",
                  batch_size: int = 32) -> DataFrame:
    """Add the generator's answers. A null prompt is not asked and gives null; a failing batch is asked again
    row by row, and a row that still fails gets the failure as its text."""
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType(), True)])

    def ask(prompts: list) -> list:
        answers = list(generator(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"generator returned {len(answers)} texts for {len(prompts)} prompts")
        return answers

    def answers_of(prompts: list) -> list:
        try:
            return ask(prompts)
        except Exception as e:  # noqa: BLE001 - failures are reported in the row
            return [f"(generation failed: {e})"] if len(prompts) == 1 else [x for p in prompts for x in answers_of([p])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            # Some rows at a time, and only their prompts as Python texts: a worker's memory does not grow with the batch.
            asked = batch.column(batch.schema.get_field_index(prompt_col)).is_valid().to_numpy(zero_copy_only=False).cumsum()
            start = 0
            while start < batch.num_rows:
                done = asked[start - 1] if start else 0
                stop = max(int(asked.searchsorted(done + batch_size, side="right")), start + 1)
                part = batch.slice(start, stop - start)
                prompts = part.column(part.schema.get_field_index(prompt_col)).to_pylist()
                there = [k for k, p in enumerate(prompts) if p is not None]
                outs: list = [None] * len(prompts)
                if there:
                    for k, answer in zip(there, answers_of([prompts[k] for k in there]), strict=True):
                        outs[k] = None if answer is None else str(answer)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(outs, pa.string())], names=[*part.schema.names, out_col])
                start = stop

    return df.mapInArrow(run, schema)


def translate_with_retry(df: DataFrame, text_col: str, language_col: str,
                         translator: Callable[[list], list], out_col: str = "translated") -> DataFrame:
    """Translate; rows whose result fails the script check are translated once more with
    the strict prompt, and the second answer is kept whatever it is. English is passed
    through without a call. Pass one is checkpointed so the generator is not called twice for a row."""
    english = F.coalesce(F.col(language_col) == "English", F.lit(False))
    passed = df.where(english).withColumn(out_col, F.col(text_col)).withColumn("retried", F.lit(False))
    asked = df.where(~english).withColumn("_p1", translate_prompt(F.col(text_col), F.col(language_col)))
    first = generate_text(asked, "_p1", translator, out_col="_t1")
    first = cut_lineage(first.withColumn("_ok", F.coalesce(is_in_language(F.col("_t1"), F.col(language_col)), F.lit(False))))
    retry = first.where(~F.col("_ok")).withColumn(
        "_p2", translate_prompt(F.col(text_col), F.col(language_col), strict=True))
    second = generate_text(retry, "_p2", translator, out_col=out_col).withColumn("retried", F.lit(True))
    kept = first.where(F.col("_ok")).withColumn(out_col, F.col("_t1")).withColumn("retried", F.lit(False))
    cols = df.columns + [out_col, "retried"]
    return passed.select(*cols).unionByName(kept.select(*cols)).unionByName(second.select(*cols))


# Deterministic stand-ins for tests and catalogue queries (no model server here). ----------
def length_generator(prompts: Sequence[str]) -> list:
    """Answers with the size of the whole prompt."""
    return [f"(stub) {len(p)} chars, {len(p.split())} words" for p in prompts]


def make_stub_translator(phrases: dict) -> Callable[[list], list]:
    """Returns English text on the first try and the language's phrase on the strict retry."""
    def tr(prompts):
        out = []
        for p in prompts:
            lang = p.split("into ", 1)[1].split(".", 1)[0] if "into " in p else "English"
            if "IMPORTANT: Do not include any English." in p:
                out.append(phrases.get(lang, ""))
            else:
                out.append(p.rsplit("---", 2)[-2].strip() if p.count("---") >= 2 else p)
        return out
    return tr
