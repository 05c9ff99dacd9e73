"""What a user may put in place of the library's own parts: sources of search results, content providers, chunkers, key-value
tables, embedders. Each is a protocol on DataFrames, columns or bytes; `Registry` holds named ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Generic, Protocol, TypeVar, runtime_checkable

from pyspark.sql import Column, DataFrame

T = TypeVar("T")

#: A column of texts and a number of dimensions to a column of vectors.
Embedder = Callable[[Column, int], Column]


@runtime_checkable
class SearchAdapter(Protocol):
    """A source of scored rows (id, source, source_id, score)."""

    name: str
    scope: str  # local or network

    def search(self, query: DataFrame, limit: int) -> DataFrame: ...


@runtime_checkable
class ContentProvider(Protocol):
    """Where blocks may be found: offers (cid, provider, rank, has) for wanted cids."""

    def offers(self, wanted: DataFrame) -> DataFrame: ...


@runtime_checkable
class Chunker(Protocol):
    """Cuts a stream of bytes: the chunks of an iterator of buffers, in order."""

    def chunks(self, buffers: Iterable[bytes]) -> Iterator[bytes]: ...


@runtime_checkable
class KvStore(Protocol):
    """A key-value table: a view (key, value), and changes applied to it."""

    def view(self) -> DataFrame: ...

    def apply(self, changes: DataFrame) -> None: ...


class Registry(Generic[T]):
    """Named parts; a name is taken once."""

    def __init__(self):
        self.held: dict[str, T] = {}

    def register(self, name: str, part: T) -> T:
        if name in self.held:
            raise ValueError(f"{name} is registered")
        self.held[name] = part
        return part

    def __getitem__(self, name: str) -> T:
        if name not in self.held:
            raise KeyError(f"unknown: {name}; there are {', '.join(sorted(self.held))}")
        return self.held[name]


def gathered(adapters: Iterable[SearchAdapter], query: DataFrame, limit: int, scope: str = "all") -> DataFrame:
    """The rows of all adapters of a scope, `limit` of each at most as they give them, as one table."""
    if scope not in ("local", "network", "all"):
        raise ValueError(f"invalid scope: {scope}")
    found = [a.search(query, limit) for a in adapters if scope in ("all", a.scope)]
    if not found:
        raise ValueError(f"no adapter for {scope}")
    return reduce(DataFrame.unionByName, found)
