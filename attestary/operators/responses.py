"""Batched inference as a table step, and reading its answers."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attestary import fixed


JOURNAL = T.StructType([T.StructField("prompt_key", T.StringType()), T.StructField("raw", T.StringType())])
JOURNAL_BATCH = 16  # answers that are written together


class Journal:
    """Answers kept in a folder that driver and executors share, one small file per batch of calls.

    A file appears under its final name when it is complete, so a task that dies leaves whole batches.
    Files are named by the run and partition that asked, so a task that runs again finds what its earlier
    attempts have answered, and later runs find all of it.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self):
        from pyarrow import fs
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def known(self, spark) -> DataFrame:
        """``prompt_key, raw`` of all answers so far."""
        system, folder = self._folder()
        system.create_dir(folder, recursive=True)
        return spark.read.schema(JOURNAL).option("pathGlobFilter", "*.json").json(self.path).where("prompt_key IS NOT NULL").dropDuplicates(["prompt_key"])

    def mine(self, run: str, partition: int) -> dict[str, str]:
        """What earlier attempts of a task have answered."""
        from pyarrow import fs
        system, folder = self._folder()
        out = {}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(f"{run}-{partition}-") and info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        row = json.loads(line)
                        out[row["prompt_key"]] = row["raw"]
        return out

    def append(self, run: str, partition: int, rows: list[tuple[str, str]]) -> None:
        system, folder = self._folder()
        name = f"{folder}/{run}-{partition}-{uuid.uuid4().hex}"
        with system.open_output_stream(name + ".part") as f:
            f.write("".join(json.dumps({"prompt_key": k, "raw": r}) + "\n" for k, r in rows).encode())
        system.move(name + ".part", name + ".json")


def infer(prompts: DataFrame, answer: Callable[[str], str], tries: int = fixed.INFER_TRIES,
          pause: float = fixed.INFER_PAUSE_SECONDS, tasks: int | None = None, journal: str | None = None) -> DataFrame:
    """Adds ``raw``, the answer of a callable to each prompt, NULL after ``tries`` failures.

    The number of partitions bounds the calls in flight; set it with ``tasks``. With ``journal``, a
    folder, answers are written there as they come: prompts answered in it are not asked again, by
    whatever run, and a task that is run again goes on behind its last written batch. Failures are
    not kept. A prompt is known by its SHA-256, so equal prompts may be asked once each in one run.
    """
    if tasks:
        prompts = prompts.repartition(tasks)

    def one(prompt: str) -> str | None:
        for attempt in range(1, tries + 1):
            try:
                return answer(prompt)
            except Exception:
                if attempt < tries:
                    time.sleep(pause * attempt)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=[one(p) for p in pdf["prompt"]])
    schema = T.StructType(prompts.schema.fields + [T.StructField("raw", T.StringType())])
    if journal is None:
        return prompts.mapInPandas(run, schema)

    book, this_run = Journal(journal), uuid.uuid4().hex
    keyed = prompts.withColumn("prompt_key", F.sha2(F.coalesce("prompt", F.lit("")), 256))
    known = book.known(prompts.sparkSession)
    # dealt by key, so that a partition holds the same prompts whenever it is run again
    open_ = keyed.join(known.select("prompt_key"), "prompt_key", "left_anti").select(*prompts.columns, "prompt_key")
    n = tasks or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = open_.repartition(n, "prompt_key")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        done, fresh = book.mine(this_run, partition), []
        for pdf in batches:
            raw = []
            for key, prompt in zip(pdf["prompt_key"], pdf["prompt"]):
                if key not in done:
                    said = one(prompt)
                    if said is not None:
                        done[key] = said
                        fresh.append((key, said))
                        if len(fresh) >= JOURNAL_BATCH:
                            book.append(this_run, partition, fresh)
                            fresh = []
                raw.append(done.get(key))
            yield pdf.drop(columns="prompt_key").assign(raw=raw)
        if fresh:
            book.append(this_run, partition, fresh)
    asked = open_.mapInPandas(ask, schema)
    return keyed.join(known, "prompt_key").select(*schema.names).unionByName(asked)


def json_salvage(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` if that is valid JSON, else NULL."""
    start = F.instr(text, "{")
    stop = F.length(text) - F.instr(F.reverse(text), "}") + 1
    cut = F.substring(text, start, stop - start + 1)
    good = (start > 0) & F.contains(text, F.lit("}")) & (stop > start)
    return F.when(good & F.try_parse_json(cut).isNotNull(), cut)


def json_unfence(text: Column) -> Column:
    """The inside of the first code fence, or the whole text."""
    fence = r"```(?:json)?\s*([\s\S]+?)\s*```"
    return F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)


def explode_responses(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per requested field: value and quote, or the error that explains their absence.

    ``batches(job_id, batch_no, field_id)``, ``responses(job_id, batch_no, raw)``.
    """
    entry = F.try_element_at(F.col("_a"), F.col("field_id"))
    is_object = entry.startswith("{")
    payload = F.from_json(F.when(is_object, entry), "value string, source_quote string")
    error = (F.when(~F.coalesce("_ok", F.lit(False)), "extraction_failed")
             .when(~F.coalesce(is_object, F.lit(False)), "field_missing_in_response"))
    # each answer is parsed once, before it meets the fields asked of it
    parsed = responses.select("job_id", "batch_no", F.try_parse_json("raw").isNotNull().alias("_v"),
                              F.from_json("raw", "map<string,string>").alias("_a"))
    parsed = parsed.select("job_id", "batch_no", "_a",
                           (F.col("_v") & F.col("_a").isNotNull()).alias("_ok"))
    return (batches.join(parsed, ["job_id", "batch_no"], "left")
            .withColumn("_p", payload).withColumn("error", error)
            .select("job_id", "batch_no", "field_id", F.col("_p.value").alias("value"),
                    F.col("_p.source_quote").alias("source_quote"), "error"))


def outcome_counts(results: DataFrame) -> DataFrame:
    has_value = F.coalesce(F.length("value") > 0, F.lit(False))
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(F.col("error").isNull() & has_value).alias("ok"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.col("error").isNull() & ~has_value).alias("empty"))
