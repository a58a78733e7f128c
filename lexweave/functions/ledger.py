"""Folds over keyed state: admission to a budget, attempts' states, leases."""

from __future__ import annotations

from decimal import Decimal

#: The caps of an episode in USD.
CAP, THIRD_CAP = Decimal("1.60"), Decimal("0.10")


def new_state() -> dict:
    """No attempts; ``total`` and ``third`` are what the attempts that aren't released commit."""
    return {"attempts": {}, "locked": False, "total": Decimal(0), "third": Decimal(0)}


def committed(state: dict, third_only: bool = False) -> Decimal:
    return state["third" if third_only else "total"]


def _book(state: dict, attempt: dict, usd: Decimal) -> None:
    state["total"] += usd
    if attempt["third"]:
        state["third"] += usd


def reserve(state: dict, batch: list[tuple[str, Decimal, bool]], downstream: Decimal = Decimal(0), cap: Decimal = CAP, third_cap: Decimal = THIRD_CAP) -> str:
    """Admit a whole batch (attempt, usd, third) or nothing of it. What was admitted before is replayed without effect."""
    if state["locked"]:
        return "integrity_locked"
    known = [state["attempts"].get(i) for i, _, _ in batch]
    if all(known):
        same = all((a["reserved"], a["third"]) == (usd, third) for a, (_, usd, third) in zip(known, batch, strict=True))
        return "replayed" if same else "conflict"
    if any(known) or len({i for i, _, _ in batch}) < len(batch) or any(usd <= 0 for _, usd, _ in batch):
        return "conflict"
    asked = sum((usd for _, usd, _ in batch), Decimal(0))
    third = sum((usd for _, usd, t in batch if t), Decimal(0))
    if committed(state) + asked + downstream > cap or committed(state, True) + third > third_cap:
        return "refused"
    for i, usd, t in batch:
        state["attempts"][i] = {"state": "reserved", "usd": usd, "reserved": usd, "third": t}
        _book(state, state["attempts"][i], usd)
    return "admitted"


def finish(state: dict, attempt: str, how: str, usd: Decimal | None = None) -> str:
    """reserved to settled, uncertain or released. Settling above the reservation locks the ledger; other steps are refused."""
    a = state["attempts"].get(attempt)
    if a is None or a["state"] not in ("reserved", "uncertain") or a["state"] == "uncertain" and how == "released":
        return "refused"
    if how == "settled":
        if usd is None or usd < 0:
            return "refused"
        _book(state, a, usd - a["usd"])
        a["state"], a["usd"] = "settled", usd
        if usd > a["reserved"]:
            state["locked"] = True
            return "overrun"
        return "settled"
    if how not in ("uncertain", "released"):
        return "refused"
    if how == "released":
        _book(state, a, -a["usd"])
    a["state"] = how
    return how


def lease(owner: tuple[str, float] | None, who: str, now: float, seconds: float = 600) -> tuple[tuple[str, float], bool]:
    """One owner at a time, until the lease runs out; an owner may renew its own."""
    if owner is None or owner[1] <= now or owner[0] == who:
        return (who, now + seconds), True
    return owner, False
