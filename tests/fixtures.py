"""The small inputs that the engine's cases share: boats, what they carry, their trips and signals."""

import json

BOATS_CSV = """boat,title,harbour,crew
11,Albatros,Kiel,4
12,Brise,Brest,2
14,Corvo,Porto,9
15,Dorado,Porto,6
17,Elster,Kiel,3
20,Falke,Oslo,12
23,Gaivota,Porto,5
"""
CARGO_CSV = """code,goods,tonnes,kind
A1,Grain,120.5,bulk
B2,Salt,80.25,bulk
C3,Fish,6.5,cold
D4,Wine,31,boxes
E5,Glass,12.75,boxes
F6,Ice,44,cold
"""
TRIPS = [
    {"trip": "t1", "boat": 11, "code": "A1", "days": 3.5}, {"trip": "t2", "boat": 11, "code": "C3", "days": 1}, {"trip": "t3", "boat": 14, "code": "B2", "days": 8},
    {"trip": "t4", "boat": 15, "code": "A1", "days": 2}, {"trip": "t5", "boat": 20, "code": "D4", "days": 5.25}, {"trip": "t6", "boat": 12, "code": "F6", "days": 4},
    {"trip": "t7", "boat": 12, "code": "A1", "days": 1.5}, {"trip": "t8", "boat": 14, "code": "D4", "days": 6},
]
_SENT = [(11, "depart"), (12, "depart"), (14, "radio"), (11, "radio"), (23, "depart"), (12, "arrive"), (11, "alarm"), (20, "radio"), (99, "depart")]
SIGNALS = [{"boat": boat, "kind": kind, "sent": f"2031-05-{17 + k}T06:40:00+02:00"} for k, (boat, kind) in enumerate(_SENT)]
GAPS = [{"n": 10, "mark": "p", "level": 2.5}, {"n": 20, "level": 7}, {"n": 30, "mark": "q", "ok": True}, {"n": 40, "level": 0}, {"mark": "r"}]


def jsonl(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def write_all(folder):
    texts = {"boats.csv": BOATS_CSV, "cargo.csv": CARGO_CSV, "trips.jsonl": jsonl(TRIPS), "signals.jsonl": jsonl(SIGNALS), "gaps.jsonl": jsonl(GAPS)}
    for name, text in texts.items():
        (folder / name).write_text(text)
    return {name.split(".")[0]: f"file://{folder}/{name}" for name in texts}
