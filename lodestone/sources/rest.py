"""Responses of declared endpoints as a data source: one partition a request, reading only.

    spark.dataSource.register(RestSource)
    spark.read.format("lodestone_rest").options(**asked(endpoints, requests, base="https://host")).load()

Only declared endpoints can be asked; path parameters are single encoded segments, and other arguments than the declared
ones are dropped. `base` is an address, or a folder of recorded responses, which may lie in any store that Arrow reads.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.connectors import render_path

SCHEMA = "no int, request string, status int, body string, error string"
#: Tries of one request, seconds that one may take, and statuses after which another try may help.
TRIES, SECONDS, AGAIN = 3, 10.0, (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Endpoint:
    name: str
    path: str
    path_params: tuple[str, ...] = ()
    query_params: tuple[str, ...] = ()


def target(endpoint: Endpoint, arguments: dict[str, str]) -> str:
    """Path and query of one request; arguments that the endpoint doesn't declare are left out."""
    query = urlencode(sorted((k, str(v)) for k, v in arguments.items() if k in endpoint.query_params))
    return render_path(endpoint.path, endpoint.path_params, arguments) + (f"?{query}" if query else "")


def recorded_name(request: str) -> str:
    """The file of a recorded response."""
    return hashlib.sha256(request.encode()).hexdigest() + ".json"


def asked(endpoints: list[Endpoint], requests: list[tuple[str, dict[str, str]]], base: str, header: str = "", secret: str = "") -> dict[str, str]:
    """Options of the source; requests are (endpoint, arguments). A secret goes into `header` of each request and into no row."""
    declared = {e.name: e for e in endpoints}
    unknown = [name for name, _ in requests if name not in declared]
    if unknown:
        raise ValueError(f"no endpoint {unknown[0]!r}")
    return {"endpoints": json.dumps([asdict(e) for e in endpoints]), "requests": json.dumps(requests), "base": base, "header": header, "secret": secret}


class _One(InputPartition):
    def __init__(self, no: int, name: str, arguments: dict[str, str]) -> None:
        self.no, self.name, self.arguments = no, name, arguments


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        """A redirect could lead anywhere, so it is a response like any other."""


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.endpoints = {e["name"]: Endpoint(e["name"], e["path"], tuple(e["path_params"]), tuple(e["query_params"])) for e in json.loads(options["endpoints"])}
        self.requests = json.loads(options["requests"])
        self.base, self.header, self.secret = options["base"].rstrip("/"), options.get("header", ""), options.get("secret", "")

    def partitions(self) -> list[InputPartition]:
        return [_One(no, name, arguments) for no, (name, arguments) in enumerate(self.requests)]

    def read(self, partition: _One) -> Iterator[tuple]:
        endpoint = self.endpoints[partition.name]
        try:
            request = target(endpoint, partition.arguments)
        except ValueError as e:
            yield partition.no, partition.name, None, None, str(e)
            return
        status, body = self.get(request)
        yield partition.no, f"{endpoint.name} {request}", status, body if status == 200 else None, None if status == 200 else f"status {status}"

    def get(self, request: str) -> tuple[int, str | None]:
        if not self.base.startswith(("http://", "https://")):
            return self.recorded(request)
        for turn in range(TRIES):
            try:
                asked_ = Request(self.base + request, method="GET", headers={self.header: self.secret} if self.header else {})
                with build_opener(_Stay).open(asked_, timeout=SECONDS) as got:
                    return got.status, got.read().decode("utf-8", "replace")
            except HTTPError as e:
                status = e.code
            except (URLError, TimeoutError):
                status = 504
            if status not in AGAIN or turn == TRIES - 1:
                return status, None
            time.sleep(0.2 * 2**turn)
        raise AssertionError

    def recorded(self, request: str) -> tuple[int, str | None]:
        store, folder = pafs.FileSystem.from_uri(self.base if "://" in self.base or self.base.startswith("file:") else f"file://{self.base}")
        try:
            with store.open_input_stream(f"{folder}/{recorded_name(request)}") as f:
                return 200, f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return 404, None


class RestSource(DataSource):
    """Rows of SCHEMA: the request's number, what was asked, the status, and the body or why there is none."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_rest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def record(responses: DataFrame, folder: str) -> None:
    """Write responses (request, body) where `base` finds them: a file each, by tasks. A rerun writes the same files."""

    def run(rows: Iterator) -> None:
        store, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{recorded_name(r['request'])}") as f:
                f.write(r["body"].encode())

    responses.select("request", F.coalesce("body", F.lit("")).alias("body")).foreachPartition(run)
