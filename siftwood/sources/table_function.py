"""Extractors as a table function of SQL: SELECT f.path, e.* FROM files f, LATERAL extract_file(f.path, f.content) e."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from siftwood.sources import extractors

RETURNS = "mime string, extractor string, outcome string, chunk_index int, text string, offset long"


def register(spark: SparkSession, more: list[tuple[str, Callable[[str, str, int], bool], extractors.Extract]] = (), name: str = "extract_file") -> None:
    """Register the function in a session.

    It gives a row for each chunk of a file's text, and one without text for files that are skipped: nothing claims
    them, they have no text, or they are null. `more` are extractors of this function alone: name, claim by (type, extension, size), and
    function, asked behind those of the library. They travel with the function, so they need not be installed where tasks run.
    """
    known = list(more)

    class ExtractFile:
        def __init__(self):
            self.more = [x for x in known if x not in extractors.REGISTRY]

        def eval(self, path: str, content: bytes) -> Iterator[tuple]:
            if path is None or content is None:
                yield None, "", "skipped", None, None, None
                return
            extractors.REGISTRY += self.more
            try:
                mime, found, outcome, parts = extractors.extract(path, content)
            finally:
                if self.more:
                    del extractors.REGISTRY[-len(self.more) :]
            for i, (text, offset) in enumerate(parts):
                yield mime, found, outcome, i, text, offset
            if not parts:
                yield mime, found, outcome, None, None, None

    spark.udtf.register(name, udtf(ExtractFile, returnType=RETURNS))
