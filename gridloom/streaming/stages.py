"""A registry of pipeline stages run as commands: estimates from earlier runs, heartbeats, failures on record."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from gridloom.functions.exprs import NO_HISTORY, OVER_HISTORY
from gridloom.operators.series import LEAST_SECONDS
from gridloom.sources.sinks import write_text

HEARTBEAT_SECONDS = 300.0


def clock(seconds: float) -> str:
    whole = max(0, round(seconds))
    return f"{whole // 3600:02d}:{whole // 60 % 60:02d}:{whole % 60:02d}"


def remaining(estimate: float | None, elapsed: float) -> str:
    if estimate is None:
        return NO_HISTORY
    return f"~{clock(estimate - elapsed)}" if estimate > elapsed else OVER_HISTORY


def load_state(path: Path) -> dict:
    """The registry as it was left, or an empty one where there is none or it cannot be read."""
    try:
        state = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        state = {}
    return state if isinstance(state, dict) and isinstance(state.get("stages"), dict) else {"stages": {}}


def run_stage(title: str, command: list[str], cwd: Path, state_path: Path, heartbeat_seconds: float = HEARTBEAT_SECONDS, say: Callable[[str], None] = print) -> float:
    """Run a command as the stage ``title`` and return its seconds.

    While it runs the registry names it as ``current`` and a heartbeat says how long is left by the last estimate. A
    success leaves its duration, and the estimate if it took LEAST_SECONDS or is the first; a failure leaves its exit
    code and count, keeps the estimate, and raises.
    """
    state = load_state(state_path)
    known = state["stages"].setdefault(title, {})
    estimate, began = known.get("estimated_duration_seconds"), time.monotonic()
    now = lambda: datetime.now(timezone.utc).isoformat(timespec="seconds")

    def save(current: float | None) -> None:
        state.pop("current", None)
        if current is not None:
            state["current"] = {"stage": title, "elapsed_seconds": round(current, 2), "estimated_duration_seconds": estimate, "updated_at": now()}
        write_text(state_path, json.dumps(state, ensure_ascii=False, indent=2, sort_keys=True))

    say(f"[início] {title} | ETA aproximado: {remaining(estimate, 0)}")
    save(0.0)
    process = subprocess.Popen(command, cwd=cwd)
    try:
        while True:
            try:
                code = process.wait(heartbeat_seconds)
                break
            except subprocess.TimeoutExpired:
                took = time.monotonic() - began
                say(f"[em andamento] {title} | {clock(took)} | ETA aproximado: {remaining(estimate, took)}")
                save(took)
    except BaseException:
        process.kill()
        process.wait()
        save(None)
        raise
    took = time.monotonic() - began
    if code:
        known["failures"] = known.get("failures", 0) + 1
        known["last_failure"] = {"exit_code": code, "elapsed_seconds": round(took, 2), "at": now()}
        save(None)
        say(f"[falha] {title} | {code}")
        raise subprocess.CalledProcessError(code, command)
    known["last_duration_seconds"] = took
    known["runs"] = known.get("runs", 0) + 1
    if estimate is None or took >= LEAST_SECONDS:
        known["estimated_duration_seconds"] = took
    save(None)
    say(f"[concluída] {title} | {clock(took)}")
    return took
