"""Calls of external hooks with a deadline.

A hook may hang, crash its interpreter or leave processes behind. With a deadline it therefore runs in
a process of its own beside the task: the process serves call after call, and when a call is over its
time, that process and all it started are killed and the next call gets a new one. Nothing else of the
task is lost. The hook travels to the process as it travels to tasks, by cloudpickle.
"""

from __future__ import annotations

import os
import pickle
import select
import signal
import struct
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, LifoQueue
from typing import Any

#: Fixed value: seconds an external call for one text may take by default.
CALL_SECONDS = 120.0
#: the error of a call that was over its time
TIME_OUT = "time-out"
#: seconds a new process may take until it listens; not part of a call
START_SECONDS = 120.0
#: processes of one task at most; another one starts only when all others are held up by a call for so many seconds
BESIDE, HELD_SECONDS = 8, 0.2

_SERVER = """
import ctypes, os, pickle, struct, sys
try:
    ctypes.CDLL(None).prctl(1, 9)  # dies with the task's process
except Exception:
    pass
out = os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)  # what the hook prints is no answer
inp = sys.stdin.buffer

def send(answer):
    data = pickle.dumps(answer)
    out.write(struct.pack("<q", len(data)))
    out.write(data)
    out.flush()

def take():
    head = inp.read(8)
    return None if len(head) < 8 else inp.read(struct.unpack("<q", head)[0])

sys.path[:] = pickle.loads(take())
from pyspark import cloudpickle
hook = cloudpickle.loads(take())
send(None)
while (data := take()) is not None:
    try:
        answer = (hook(pickle.loads(data)), None)
        pickle.dumps(answer)
    except Exception as failure:
        answer = (None, f"{type(failure).__name__}: {failure}")
    send(answer)
"""


class _Late(Exception):
    """The process gave no answer in time."""


class _Gone(Exception):
    """The process ended instead of answering."""


class _Process:
    """One interpreter that serves calls of one hook."""

    def __init__(self, hook: bytes) -> None:
        self.process = subprocess.Popen(
            [sys.executable, "-c", _SERVER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, start_new_session=True, bufsize=0
        )
        for end in (self.process.stdin, self.process.stdout):
            os.set_blocking(end.fileno(), False)
        limit = time.monotonic() + START_SECONDS
        try:
            self._write(pickle.dumps([p for p in sys.path if p]), limit)
            self._write(hook, limit)
            self._read(limit)
        except _Late:
            self.end()
            raise RuntimeError("the process of the calls did not start") from None
        except _Gone:
            raise RuntimeError(f"the process of the calls ended at its start with {self.end()}") from None

    def call(self, argument: Any, seconds: float) -> tuple[Any, str | None]:  # noqa: ANN401
        limit = time.monotonic() + seconds
        self._write(pickle.dumps(argument), limit)
        return pickle.loads(self._read(limit))

    def _wait(self, read: list, write: list, limit: float) -> None:
        left = limit - time.monotonic()
        if left <= 0 or not any(select.select(read, write, [], left)[:2]):
            raise _Late

    def _write(self, data: bytes, limit: float) -> None:
        pipe = self.process.stdin.fileno()
        rest = memoryview(struct.pack("<q", len(data)) + data)
        while rest:
            self._wait([], [pipe], limit)
            try:
                rest = rest[os.write(pipe, rest[: 1 << 16]) :]
            except BlockingIOError:
                continue
            except BrokenPipeError:
                raise _Gone from None

    def _exactly(self, size: int, limit: float) -> bytes:
        pipe, parts = self.process.stdout.fileno(), []
        while size:
            self._wait([pipe], [], limit)
            part = os.read(pipe, min(size, 1 << 20))
            if not part:
                raise _Gone
            parts.append(part)
            size -= len(part)
        return b"".join(parts)

    def _read(self, limit: float) -> bytes:
        return self._exactly(struct.unpack("<q", self._exactly(8, limit))[0], limit)

    def end(self) -> int | None:
        """Kill the process and what it started."""
        try:
            os.killpg(self.process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        for end in (self.process.stdin, self.process.stdout):
            end.close()
        return self.process.wait()


class Calls:
    """Calls of a hook from one task: ``(answer, error)`` for each argument, never an exception.

    Without ``seconds`` the hook runs in the task itself and a call may take for ever.
    """

    def __init__(self, hook: Callable[[Any], Any], seconds: float | None = None) -> None:
        if seconds is not None and seconds <= 0:
            raise ValueError(f"a call needs time, not {seconds} seconds")
        self.hook, self.seconds = hook, seconds
        self._packed: bytes | None = None
        self._process: _Process | None = None
        self._free: LifoQueue[Calls] = LifoQueue()
        self._lanes: list[Calls] = [self]
        self._threads: ThreadPoolExecutor | None = None
        self._lock = threading.Lock()
        self._free.put(self)

    def many(self, arguments: Iterable[Any]) -> list[tuple[Any, str | None]]:
        """The answers in the order of the arguments; calls that take long run side by side, if there is a deadline."""
        if self.seconds is None:
            return [self(a) for a in arguments]
        if self._threads is None:  # they stay: a process dies with the thread that started it
            self._threads = ThreadPoolExecutor(BESIDE)
        return list(self._threads.map(self._in_lane, arguments))

    def _in_lane(self, argument: Any) -> tuple[Any, str | None]:  # noqa: ANN401
        lane = self._lane()
        try:
            return lane(argument)
        finally:
            self._free.put(lane)

    def _lane(self) -> Calls:
        try:
            return self._free.get(timeout=HELD_SECONDS)
        except Empty:
            with self._lock:
                if len(self._lanes) < BESIDE:
                    self._lanes.append(Calls(self.hook, self.seconds))
                    return self._lanes[-1]
        return self._free.get()

    def __call__(self, argument: Any) -> tuple[Any, str | None]:  # noqa: ANN401
        try:
            return (self.hook(argument), None) if self.seconds is None else self._timed(argument)
        except Exception as failure:  # noqa: BLE001 - any failure of the hook is data
            return None, f"{type(failure).__name__}: {failure}"

    def _timed(self, argument: Any) -> tuple[Any, str | None]:  # noqa: ANN401
        if self._process is None:
            if self._packed is None:
                from pyspark import cloudpickle

                self._packed = cloudpickle.dumps(self.hook)
            self._process = _Process(self._packed)
        try:
            return self._process.call(argument, self.seconds)
        except _Late:
            self.close()
            return None, TIME_OUT
        except _Gone:
            return None, f"the process of the call ended with {self.close()}"

    def close(self) -> int | None:
        """End the process, if there is one; the next call starts another."""
        process, self._process = self._process, None
        return process.end() if process else None

    def __enter__(self) -> Calls:
        return self

    def __exit__(self, *_: object) -> None:
        for lane in self._lanes:
            lane.close()
        if self._threads is not None:
            self._threads.shutdown()
