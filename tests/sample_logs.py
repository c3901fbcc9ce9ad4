"""Three small logs of one evening at a made-up shop, and the people in them."""

from __future__ import annotations

import json
from pathlib import Path

GUESSER, PROBER, CUSTOMER = "203.0.113.77", "198.51.100.23", "10.9.8.7"


def _hit(ip: str, time: str, request: str, status: int) -> str:
    return f'{ip} - - [14/Mar/2026:{time} +0000] "{request} HTTP/1.1" {status} 64 "-" "agent/1.0"'


def web_lines() -> list[str]:
    return [
        _hit(CUSTOMER, "21:00:00", "GET /shop", 200),
        *[_hit(GUESSER, f"21:05:{s:02d}", "POST /account/login", 401) for s in range(0, 50, 10)],
        _hit(GUESSER, "21:05:50", "POST /account/login", 200),
        _hit(GUESSER, "21:06:00", "GET /export/orders", 200),
        _hit(PROBER, "21:40:00", "GET /item?id=7%20UNION%20SELECT%20pin", 404),
        _hit(PROBER, "21:40:30", "GET /img/..%2F..%2Fnotes.txt", 200),
        _hit(PROBER, "21:41:00", "GET /note?t=%3Cscript%3Ex", 400),
        _hit(CUSTOMER, "22:00:00", "GET /help", 200),
    ]


def auth_lines() -> list[str]:
    return [
        *[f"Mar 14 21:05:{s:02d} gate sshd[77]: Failed password for carol from {GUESSER} port 4022 ssh2" for s in range(2, 42, 10)],
        f"Mar 14 21:42:00 gate sshd[78]: maximum authentication attempts exceeded for dave from {PROBER} port 4023 ssh2",
        f"Mar 14 22:01:00 gate sshd[79]: Accepted publickey for erin from {CUSTOMER} port 4024 ssh2",
    ]


def app_objects() -> list[dict]:
    return [
        {"timestamp": "2026-03-14T21:43:00.000Z", "level": "error", "service": "calc", "message": "odd input",
         "ip": PROBER, "method": "GET", "endpoint": "/calc?x=$(reboot)", "statusCode": 500},
        {"timestamp": "2026-03-14T22:02:00.000Z", "level": "info", "service": "cart", "message": "opened", "ip": CUSTOMER,
         "user": "erin", "method": "GET", "endpoint": "/cart", "statusCode": 200, "items": 3},
    ]


def write_all(folder: Path) -> Path:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "shop-access.log").write_text("\n".join(web_lines()) + "\n")
    (folder / "gate-auth.log").write_text("\n".join(auth_lines()) + "\n")
    (folder / "shop-app.json").write_text("\n".join(json.dumps(o, indent=4) for o in app_objects()))
    return folder
