"""A registry of extractors. Each file is read by a child process with a time limit, so one that hangs or dies costs its own record alone."""

from __future__ import annotations

import json
import multiprocessing
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.connection import wait

import pandas as pd
from pyspark.sql import DataFrame

from filecat.operators.normalize import extractor_for

RECORD = "node_id string, extractor_name string, extractor_version string, status string, raw_payload string, warnings array<string>"


@dataclass
class Extractor:
    """fn takes and gives iterators of pandas frames (node_id, content) -> (node_id, raw_payload). A task has so many children of it."""

    name: str
    version: str
    fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    seconds: float = 30
    limit: int = 16 << 20
    children: int = 8


def _serve(pipe, fn: Callable) -> None:
    """The child: one file after another, until the parent closes the pipe."""
    while True:
        try:
            node, content = pipe.recv()
        except EOFError:
            return
        try:
            frames = list(fn(iter([pd.DataFrame({"node_id": [node], "content": [content]})])))
            pipe.send((True, "".join(text for frame in frames for text in frame["raw_payload"])))
        except Exception as error:  # noqa: BLE001  a failed record is the result
            pipe.send((False, str(error) or type(error).__name__))


class Child:
    """A child process that reads files for one extractor, one at a time; a new one takes its place after a hang or a crash."""

    def __init__(self, extractor: Extractor):
        self.extractor, self.process = extractor, None

    def give(self, node: str, content: bytes) -> tuple[bool, str] | None:
        """Begins with a file; its result, if that is known at once."""
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.pipe, inner = context.Pipe()
            self.process = context.Process(target=_serve, args=(inner, self.extractor.fn), daemon=True)
            self.process.start()
            inner.close()
        try:
            self.pipe.send((node, content))
        except OSError:
            return self.end("extractor ended before it had a result")
        self.until = time.monotonic() + self.extractor.seconds
        return None

    def take(self) -> tuple[bool, str] | None:
        """The result of the file; none while there is time left for it."""
        try:
            if self.pipe.poll():
                return self.pipe.recv()
        except (EOFError, OSError):
            return self.end("extractor ended before it had a result")
        return self.end(f"extractor took longer than {self.extractor.seconds:g} s") if time.monotonic() >= self.until else None

    def end(self, error: str = "") -> tuple[bool, str]:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None
        return False, error


def _read(files: Iterator[tuple[str, bytes]], extractor: Extractor, children: list[Child]) -> Iterator[tuple[str, bool, str]]:
    """node_id, done and text of each file, as they come. While a child hangs, which costs time but no work, the others go on."""
    busy: dict[Child, str] = {}

    def results() -> list[tuple[str, bool, str]]:
        wait([c.pipe for c in busy], max(0, min(c.until for c in busy) - time.monotonic()))
        return [(busy.pop(c), *found) for c in list(busy) if (found := c.take())]

    for node, content in files:
        if len(content) > extractor.limit:
            yield node, False, "file is too large"
            continue
        while len(busy) == len(children):
            yield from results()
        child = next(c for c in children if c not in busy)
        found = child.give(node, content)
        if found:
            yield node, *found
        else:
            busy[child] = node
    while busy:
        yield from results()


def run_extractor(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Records of files (node_id, mime_type, content) that F3 routes to the extractor.

    A file above the size limit, one that takes too long, and one that the extractor fails or dies on become
    failed records; all others go on. A null content is an empty file; an empty table gives no record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        children = [Child(extractor) for _ in range(extractor.children)]
        try:
            for batch in batches:
                files = ((node, bytes(content) if content is not None else b"") for node, content in zip(batch["node_id"], batch["content"]))
                out = [(node, extractor.name, extractor.version, "completed" if done else "failed", text if done else json.dumps({"error": text}), [] if done else [text]) for node, done, text in _read(files, extractor, children)]
                yield pd.DataFrame(out, columns=["node_id", "extractor_name", "extractor_version", "status", "raw_payload", "warnings"])
        finally:
            for child in children:
                child.end()

    routed = files.where(extractor_for("mime_type") == extractor.name).select("node_id", "content")
    return routed.mapInPandas(run, RECORD)


class Registry:
    """Extractors by name; the version is part of every record, so a new version makes old records candidates for W3."""

    def __init__(self) -> None:
        self.extractors: dict[str, Extractor] = {}

    def register(self, name: str, version: str, fn: Callable, seconds: float = 30, limit: int = 16 << 20) -> None:
        if name in self.extractors:
            raise ValueError(f"an extractor named {name} is registered already")
        self.extractors[name] = Extractor(name, version, fn, seconds, limit)

    def run(self, files: DataFrame) -> DataFrame:
        """Records of all files that a registered extractor reads."""
        if not self.extractors:
            raise ValueError("no extractor is registered")
        first, *rest = (run_extractor(files, e) for e in self.extractors.values())
        for more in rest:
            first = first.unionByName(more)
        return first
