"""Schemas of the transactional envelope, results, versions and requests, and the ranks of votes."""

from __future__ import annotations

COMMIT, ABORT, REPLAY = "COMMIT", "ABORT", "REPLAY"
#: Merging votes takes the greatest rank.
RANKS = {COMMIT: 0, ABORT: 1, REPLAY: 2}

STEP = "struct<off:int,size:int>"
PATH = f"array<{STEP}>"
ENVELOPE = f"tid long, path {PATH}, vote string"


def update(value: str) -> str:
    return f"struct<ns:string,key:string,value:{value}>"


def results(original: str, value: str) -> str:
    return f"tid long, ts long, original {original}, vote string, updates array<{update(value)}>"


def versions(value: str) -> str:
    return f"ns string, key string, version long, created_by long, status string, value {value}"


WAL = "vote string, tid long, ts long, source int, updates array<struct<ns:string,key:string,value:double>>"
QUERY = "query_id string, ns string, keys array<string>, watermark long"
COMMANDS = "spu_id string, ord long, ns string, key string, method string, params array<double>"
