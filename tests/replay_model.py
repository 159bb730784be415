"""The rules as a plain event-by-event simulation of one command log, for comparison."""

from __future__ import annotations

from delayfold.model import MAX_DELAY_MS


def in_order(commands):
    """Reads each partition by offset; an ID's clock there never goes back. Merges them by that clock."""
    clocks, read = {}, []
    for command in sorted(commands, key=lambda c: c["offset"]):
        lane = command["schedule_id"], command["source_topic"], command["partition"]
        clocks[lane] = max(clocks.get(lane, command["arrival_ms"]), command["arrival_ms"])
        read.append({**command, "seen_ms": clocks[lane]})
    place = lambda c: (c["seen_ms"], c["source_topic"], c["partition"], c["offset"])
    return sorted(read, key=place)


def replay(commands, as_of=None, gate=0, complete=False):
    """Commands are dicts; returns {offset: (outcome, closed_ms)} of the updates."""
    seen = in_order(
        c
        for c in commands
        if (as_of is None or c["arrival_ms"] <= as_of)
        and (complete or not (c["command"] == "delete" and c["is_expired"]))
    )
    pending, ends = {}, {}

    def fire_until(ms):
        for key, (update, fire) in list(pending.items()):
            if ms is None or fire < ms:
                ends[update["offset"]] = ("fired", fire)
                del pending[key]

    for command in seen:
        now, key, kind = command["seen_ms"], command["schedule_id"], command["command"]
        fire_until(now)
        if kind == "delete" and command["is_expired"]:
            if complete and key in pending and pending[key][0]["due_ms"] <= now:
                ends[pending.pop(key)[0]["offset"]] = ("completed", now)
            continue
        if key in pending:
            end = {"update": "superseded", "delete": "canceled"}.get(kind, "canceled_by_error")
            ends[pending.pop(key)[0]["offset"]] = (end, now)
        if kind == "update":
            fire = max(now, min(command["due_ms"], now + MAX_DELAY_MS), gate)
            pending[key] = (command, fire)
    fire_until(None if as_of is None else as_of + 1)
    for update, _ in pending.values():
        ends[update["offset"]] = ("pending", None)
    return ends
