"""Row-by-row evaluations of small fixtures, written for the tests."""

from __future__ import annotations

import hashlib
import hmac


def hmac_hex(secret: str, body: bytes) -> str:
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def label_history(events):
    """events: (issue, order, kind, class) -> {order: label set after the event, as text}.

    A comment leaves its own label alone; any other event adds its label.  So the labels after an event are
    those of the events since the issue's latest comment, that comment included.
    """
    out = {}
    for issue, order, _, _ in events:
        past = [e for e in events if e[0] == issue and e[1] <= order]
        since = max([e[1] for e in past if e[2] == "comment"], default=-1)
        out[order] = ",".join(sorted({"complexity:" + e[3] for e in past if e[1] >= since}))
    return out
