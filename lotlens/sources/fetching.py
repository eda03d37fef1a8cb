"""Fetchers: functions named by import path, ``package.module:function``, that executors load and call.

A fetcher takes a request, a dict of text, and gives the answer's text. Its errors are errors of the reader: nothing
that couldn't be fetched is passed over as empty.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame

Fetcher = Callable[[dict[str, str]], str]


@cache
def fetcher(path: str) -> Fetcher:
    module, _, name = path.partition(":")
    if not name:
        raise ValueError(f"a fetcher is named as package.module:function, not {path!r}")
    return getattr(import_module(module), name)


def fetched(path: str, request: dict[str, str], attempts: int = 4, wait: float = 2.0) -> str:
    """The answer; tried again after growing waits, also where the server answers with a report of an exception."""
    said: Exception | None = None
    for i in range(attempts):
        if i:
            time.sleep(wait * i)
        try:
            text = fetcher(path)(request)
        except (ImportError, AttributeError, ValueError):
            raise
        except Exception as e:  # the last one is raised below
            said = e
            continue
        if "ExceptionReport" not in text[:2000]:
            return text
        said = RuntimeError(f"the server refused: {text[:200]}")
    raise RuntimeError(f"no answer to {request} after {attempts} attempts") from said


def announced(answer: str) -> int | None:
    """The number of features that an answer says there are, in XML or JSON."""
    found = re.search(r'"?numberMatched"?\s*[=:]\s*"?(\d+)', answer)
    return int(found[1]) if found else None


# Answers kept as files.

def save_answers(answers: DataFrame, folder: str) -> None:
    """answers: layer, start, body. One file an answer, for ``saved_answer``."""
    answers.select("layer", "start", "body").repartition("layer", "start").write.partitionBy("layer", "start").text(folder)


def saved_answer(request: dict[str, str]) -> str:
    """The answer that was saved for a layer and start below request['folder']; of a request for the number alone, without its features."""
    from pyarrow import fs

    where, top = fs.FileSystem.from_uri(request["folder"])
    folder = f"{top}/layer={request['layer']}/start={request.get('start', '0')}"
    files = [f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.size and f.base_name.startswith("part-")]
    text = "\n".join(where.open_input_stream(f).read().decode() for f in sorted(files)).rstrip("\n")
    if request.get("hits"):
        return json.dumps({"numberMatched": announced(text)})
    return text
