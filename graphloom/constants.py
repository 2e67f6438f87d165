"""Fixed values of the data model."""

# Statuses, layers and weights of the data model.
CLOSED = ("closed", "cancelled", "superseded", "retracted")
HIDDEN = ("superseded", "retracted", "cancelled")
STATUSES = {
    "task": ("open", "in_progress", "blocked", "closed", "cancelled"),
    "note": ("active", "superseded", "retracted"),
    "doc": ("active", "stale", "retracted"),
    "fragment": ("active", "superseded", "retracted"),
    "session": ("open", "closed"),
    "message": ("active",),
    "entity": ("active", "superseded", "retracted"),
    "anchor": ("fresh", "drifted", "stale", "lost"),
    "skill": ("active", "superseded", "retracted"),
}
LAYERS = {"task": 1, "note": 1, "doc": 1, "fragment": 1, "anchor": 1, "session": 0, "message": 0, "entity": 2, "skill": 3}
READY_WEIGHTS = {"priority": 0.4, "unblocks": 0.27, "freshness": 0.14, "anchors": 0.1, "type": 0.09}
DAY_MS = 86_400_000
PENDING = "pending_review"
LEASE_MS = 900_000
RENEW_MS = 300_000

#: The instant that queries of this repository take as now: 2026-01-01 UTC.
NOW_MS = 1_767_225_600_000
