"""Driving batches through a provider behind injected callables: bounded windows, requeues, retries, and a ledger that is written first.

Only batch descriptors (tag and ids of one batch) are on the driver; rows stay in tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from millrace.errors import ContractError

IN_FLIGHT, MOST_INCOMPLETE = 4, 3
BACKOFF = (4.0, 16.0, 64.0)

Batch = dict[str, Any]


def with_retry(call: Callable[[], Any], transient: Callable[[Exception], bool], sleep: Callable[[float], None], backoff: Sequence[float] = BACKOFF) -> Any:
    """``call``'s result; a transient error is tried again after each pause, any other and the last one are raised."""
    for pause in backoff:
        try:
            return call()
        except Exception as error:
            if not transient(error):
                raise
        sleep(pause)
    return call()


def consistent(ledger: Sequence[Batch], model: str, prompt_sha: str) -> None:
    """A run that goes on must have the ledger's model and prompt."""
    odd = [b["tag"] for b in ledger if (b["model"], b["prompt_sha"]) != (model, prompt_sha)]
    if odd:
        raise ContractError("batches of another model or prompt", len(odd), odd[:10])


def resume(ledger: Sequence[Batch], adopt: Callable[[Batch], str | None], harvest: Callable[[str], list[str]], save: Callable[[Batch], None]) -> list[str]:
    """Harvests every open batch of an earlier run before anything new is sent, since it is paid for. Returns the ids to be sent again.

    A ledger row without an id was written before its batch was created: ``adopt`` looks for the batch at the provider and
    gives its id or None, in which case nothing was created, the row is closed as abandoned and its documents come back as
    not done. ``save`` is called with each changed row as soon as it changes.
    """
    again: list[str] = []
    for row in ledger:
        if row.get("harvested"):
            continue
        if not row.get("batch_id"):
            found = adopt(row)
            if found is None:
                row |= {"status": "abandoned", "harvested": True}
                save(row)
                again += row.get("doc_ids", [])
                continue
            row["batch_id"] = found
            save(row)
        again += harvest(row["batch_id"])
        row |= {"status": "harvested", "harvested": True}
        save(row)
    return again


def run_wave(batches: Iterable[Batch], submit: Callable[[Batch], str], harvest: Callable[[str], list[str]], record: Callable[[Batch, str], None], window: int = IN_FLIGHT, most_incomplete: int = MOST_INCOMPLETE) -> list[str]:
    """Sends all batches, at most ``window`` at a time, oldest harvested first; ``batches`` is drawn from as they are sent, so it may be longer than the driver could hold.

    ``record`` is called with the state ``intent`` before a batch is sent and with its id after, so a crash between the two
    can be found and adopted. ``harvest`` returns the ids that came back without a result; these are sent again as a batch
    of their own, behind all others. The ``most_incomplete``-th incomplete batch ends the requeues with an error. Returns
    the harvested batches' ids.
    """
    waiting, again, flying, done, incomplete = iter(batches), deque(), deque(), [], 0
    while True:
        while len(flying) < window:
            batch = next(waiting, None) or (again.popleft() if again else None)
            if batch is None:
                break
            record(batch, "intent")
            batch_id = submit(batch)
            record(batch, batch_id)
            flying.append((batch, batch_id))
        if not flying:
            return done
        batch, batch_id = flying.popleft()
        left = harvest(batch_id)
        done.append(batch_id)
        if left:
            incomplete += 1
            if incomplete >= most_incomplete:
                raise ContractError("batches keep coming back incomplete", len(left), left[:10])
            again.append(batch | {"tag": f"{batch['tag']}-requeue{incomplete}", "doc_ids": left})
