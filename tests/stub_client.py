"""Stand-ins for injected clients, importable by workers."""

import os
import time

SEEN: dict[str, int] = {}


def export(key):
    SEEN[key] = SEEN.get(key, 0) + 1
    if key.startswith("later"):
        return {"http": 503 if SEEN[key] < 3 else 200, "name": "n", "content": b"x"}
    if key.startswith("busy"):
        return {"http": 429}
    if key.startswith("dead"):
        raise OSError("no network")
    return {"http": int(key.split("-")[0]), "name": key, "mimeType": "m", "modifiedTime": str(os.getpid()), "content": b"PK"}


def label(row):
    if "hang" in row["text"]:
        time.sleep(600)
    if "raise" in row["text"]:
        raise ValueError("model is down")
    return {"c_sensitivity": "Confidential" if "mail" in row["text"] else "Public", "c_rationale": row["text"][:3]}


def risk(row):
    if "risk fails" in row["text"]:
        raise RuntimeError("no answer")
    return {"detected": False, "recommendedSensitivity": "Confidential", "reasons": [], "riskRationale": "fine"}


def answer(row):
    if row["k"] == 2:
        time.sleep(600)
    return '{"pages":[{"pageNumber":1,"blocks":[{"kind":"paragraph","text":"t%d"}]}]}' % row["k"]
