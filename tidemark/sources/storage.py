"""Shared storage: checkpoint folder, staged writes and publishing."""

import contextlib
import json
import os
import socket
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may go without it; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def use_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; inside a scratch_scope it lives as long as that."""
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch folders made within it. Nothing that is read later may still need them."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            drop_scratch(spark, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch_path named; it may be gone already."""
    if "/tidemark/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to a new scratch folder and read back, and that folder: later plans start from its files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The whole name of a folder, with a slash at its end."""
    fs, p = _file_system(spark, path)
    return str(fs.makeQualified(p).toString()).rstrip("/") + "/"


def overlapping(a: str, b: str) -> bool:
    """Whether two qualified paths are the same folder or one lies in the other."""
    return a.startswith(b) or b.startswith(a)


_WATCHERS: list[Callable[[int], None]] = []


@contextlib.contextmanager
def watched_moves(tell: Callable[[int], None]) -> Iterator[None]:
    """Calls ``tell`` with the number of moves made so far, after each one within."""
    made = [0]

    def count(_: int) -> None:
        made[0] += 1
        tell(made[0])
    _WATCHERS.append(count)
    try:
        yield
    finally:
        _WATCHERS.remove(count)


def _move(spark: SparkSession, source: str, dest: str) -> None:
    fs, src = _file_system(spark, source)
    _, dst = _file_system(spark, dest)
    if dst.getParent() is not None:
        fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {dest}")
    for tell in list(_WATCHERS):
        tell(0)


def stage(df: DataFrame, dest: str, fmt: str = "parquet", **options) -> str:
    """Write to a new folder next to the destination; readers of the destination see nothing of it.

    If the write fails nothing of it stays.
    """
    staged = f"{dest.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).options(**options).save(staged)
    except Exception:
        discard(df.sparkSession, staged)
        raise
    return staged


class PublicationBusy(RuntimeError):
    """Another publication of the destination is under way."""


class LeaseLost(RuntimeError):
    """A publication outlived its lease and was taken over; it touches nothing any more."""


#: Seconds after the last move in which a publication is taken to be alive.
LEASE = 900.0


@dataclass(frozen=True)
class Publication:
    """What one set of folders is published as: the manifest beside each of its destinations.

    An entry is (destination, staged folder, where the old data goes, whether there was any).
    """

    run: str
    owner: str
    entries: tuple[tuple[str, str, str, bool], ...]

    @property
    def home(self) -> str:
        return self.entries[0][0].rstrip("/")

    @property
    def lease(self) -> str:
        return f"{self.home}.publish-lease-{self.run}"

    @property
    def done(self) -> str:
        return f"{self.home}.published-{self.run}"


def _manifest(dest: str) -> str:
    return f"{dest.rstrip('/')}.publish-manifest"


def _write_note(spark: SparkSession, path: str, text: str, exclusive: bool = False) -> None:
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, not exclusive)
    except Py4JJavaError as e:
        if exclusive and fs.exists(p):
            raise PublicationBusy(f"being published: {path.removesuffix('.publish-manifest')}") from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_note(spark: SparkSession, path: str) -> str | None:
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publication_of(spark: SparkSession, dest: str) -> Publication | None:
    """The publication that a destination is part of just now, if there is one."""
    text = _read_note(spark, _manifest(dest))
    if not text:
        return None
    told = json.loads(text)
    return Publication(told["run"], told["owner"], tuple(tuple(e) for e in told["entries"]))


def _alive(spark: SparkSession, found: Publication) -> bool:
    until = _read_note(spark, found.lease)
    return bool(until) and time.time() < float(until)


def _renew(spark: SparkSession, own: Publication) -> None:
    """Lengthen the lease before a move; a publication whose manifest was taken away must not go on."""
    now = publication_of(spark, own.home)
    if now is None or now.run != own.run or now.owner != own.owner:
        raise LeaseLost(f"publication of {own.home} was taken over")
    _write_note(spark, own.lease, str(time.time() + LEASE))


def resolve(spark: SparkSession, dest: str) -> str | None:
    """The folder that holds a destination's data now; None if there is none yet. Nothing is moved.

    While a set is being published, and after its driver died, that is the old data of every destination in the set, until
    all of them are in place.
    """
    for _ in range(3):
        found = publication_of(spark, dest)
        if found is None or path_exists(spark, found.done):
            return dest if path_exists(spark, dest) else None
        _, folder, old, had = next(e for e in found.entries if e[0] == dest)
        if had and path_exists(spark, old):
            return old
        if had and path_exists(spark, dest) and path_exists(spark, folder):
            return dest  # not moved yet
        if not had:
            return None
    return dest if path_exists(spark, dest) else None  # finished in the meantime


def _undo(spark: SparkSession, entries: Sequence[tuple[str, str, str, bool]]) -> None:
    """Put every destination back to what it was; only what this publication staged is ever moved away."""
    for dest, folder, old, had in reversed(entries):
        if had and path_exists(spark, old):
            if path_exists(spark, dest):
                _move(spark, dest, folder)
            _move(spark, old, dest)
        elif not had and path_exists(spark, dest) and not path_exists(spark, folder):
            _move(spark, dest, folder)


def _finish(spark: SparkSession, found: Publication, done: bool) -> None:
    """Delete what a publication leaves behind; old data only if all the new data is in place.

    Manifests go after the folders, and the mark of success last, so that an interrupted clean-up is done again.
    """
    for _, folder, old, _ in found.entries:
        for left in (folder, old) if done else (folder,):
            if path_exists(spark, left):
                discard(spark, left)
    for dest, _, _, _ in reversed(found.entries):
        discard(spark, _manifest(dest))
    discard(spark, found.lease)
    if done:
        discard(spark, found.done)


def recover(spark: SparkSession, dests: Sequence[str]) -> None:
    """For writers: bring destinations whose publication was left by a dead driver back to a whole state.

    A set whose folders were all in place keeps its new data, any other set gets its old data back. A publication whose
    lease runs is left alone and is an error here. Readers use ``resolve``.
    """
    for dest in dests:
        found = publication_of(spark, dest)
        if found is None:
            continue
        if _alive(spark, found):
            raise PublicationBusy(f"being published by {found.owner}: {dest}")
        taken = replace(found, owner=_owner())
        for entry in taken.entries:
            _write_note(spark, _manifest(entry[0]), _text_of(taken))
        _write_note(spark, taken.lease, str(time.time() + LEASE))
        done = path_exists(spark, taken.done)
        if not done:
            _undo(spark, taken.entries)
        _finish(spark, taken, done)


def _owner() -> str:
    return f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex[:8]}"


def _text_of(found: Publication) -> str:
    return json.dumps({"run": found.run, "owner": found.owner, "entries": found.entries})


def publish(spark: SparkSession, staged: dict[str, str]) -> None:
    """Put staged folders in the place of their destinations, all or none; a failure leaves the old data and no staged folder.

    A manifest of the whole set is created beside every destination first, which only one publication can do. Readers of this
    library resolve it and see the old data of all destinations until the last folder is in place. If the driver dies, its
    lease runs out and the next writer finishes or undoes what it left. A reader that opens a destination's folder by itself,
    between its two moves, can find it missing or a mix: only a transactional table format would prevent that. On object stores
    a move is a copy, and exclusive creation is up to the store.
    """
    recover(spark, list(staged))
    run = uuid.uuid4().hex
    own = Publication(run, _owner(), tuple(
        (dest, folder, f"{dest.rstrip('/')}.replaced-{run}", path_exists(spark, dest)) for dest, folder in staged.items()))
    noted = []
    try:
        _write_note(spark, own.lease, str(time.time() + LEASE))
        for dest in staged:
            _write_note(spark, _manifest(dest), _text_of(own), exclusive=True)
            noted.append(dest)
    except Exception:
        for left in [_manifest(d) for d in noted] + [own.lease] + list(staged.values()):
            discard(spark, left)
        raise
    try:
        for dest, folder, old, had in own.entries:
            _renew(spark, own)
            if had:
                _move(spark, dest, old)
            _move(spark, folder, dest)
        _renew(spark, own)
        _write_note(spark, own.done, "")
    except LeaseLost:
        raise
    except Exception:
        _undo(spark, own.entries)
        _finish(spark, own, False)
        raise
    _finish(spark, own, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder or note of this library's own making, if it is there."""
    if not any(mark in path for mark in (".staged-", ".replaced-", ".publish-", ".published-")):
        raise ValueError(f"not a folder of this library's own: {path}")
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
