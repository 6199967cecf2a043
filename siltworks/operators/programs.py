"""Programs as stages: bytes in, bytes out, where the rows are."""

from __future__ import annotations

import os
import signal
import subprocess
import tempfile

#: Stand for task-local files among a program's arguments; without them bytes go through stdin and stdout.
IN, OUT = "{in}", "{out}"
TIMEOUT = 600.0
#: Characters of a program's own words that an error keeps.
KEPT = 4000


class ProgramError(Exception):
    """A program that failed: its return code (null: it took too long), command and words."""

    def __init__(self, command: list[str], code: int | None, stdout: bytes, stderr: bytes, seconds: float):
        self.command, self.code, self.seconds = command, code, seconds
        self.stdout, self.stderr = (x.decode("utf-8", "replace").strip()[-KEPT:] for x in (stdout, stderr))
        super().__init__(self.text())

    def text(self) -> str:
        ended = f"retcode: {self.code}" if self.code is not None else f"stopped after {self.seconds:g} s"
        lines = [ended, f"command: {' '.join(self.command)}", *(f"{k}: {v}" for k, v in (("stdout", self.stdout), ("stderr", self.stderr)) if v)]
        return "\n\t".join(lines)


def run_program(args: tuple[str, ...], raw: bytes, timeout: float = TIMEOUT) -> bytes:
    """What the program ``args`` makes of ``raw``.

    An empty argument is refused. Files lie in a folder that is removed however
    the program ends; one that takes longer than ``timeout`` seconds is killed
    with all that it has started. A failure raises :class:`ProgramError`.
    """
    if not args or any(not a for a in args):
        raise ValueError(f"empty argument in {args}")
    with tempfile.TemporaryDirectory(prefix="program-") as folder:
        paths = {IN: f"{folder}/in", OUT: f"{folder}/out"}
        command = [a.replace(IN, paths[IN]).replace(OUT, paths[OUT]) for a in args]
        by_file, to_file = (any(mark in a for a in args) for mark in (IN, OUT))
        if by_file:
            with open(paths[IN], "wb") as file:
                file.write(raw)
        # a session of its own, so that all its processes can be ended
        process = subprocess.Popen(command, stdin=subprocess.DEVNULL if by_file else subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        try:
            told, words = process.communicate(None if by_file else raw, timeout=timeout)
            code = process.returncode
        except subprocess.TimeoutExpired:
            _end(process)
            told, words = process.communicate()
            code = None
        except BaseException:
            _end(process)
            process.communicate()
            raise
        if code != 0:
            raise ProgramError(command, code, told, words, timeout)
        if not to_file:
            return told
        try:
            with open(paths[OUT], "rb") as file:
                return file.read()
        except FileNotFoundError:
            raise ProgramError(command, code, told, words or b"no output file", timeout) from None


def _end(process: subprocess.Popen) -> None:
    try:
        os.killpg(process.pid, signal.SIGKILL)
    except ProcessLookupError:
        pass
