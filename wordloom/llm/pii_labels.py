"""A small labelled table for the personal-data tagger.

Own sentences; ``{kind:...}`` marks personal data.  The table is small on
purpose: the features are word shapes, so a few lines of each shape settle the
weights.  ``HELD_OUT`` is never trained on."""

from __future__ import annotations

import re

TRAIN = [
    "Please write to {email:ann.lee@post.example.com} before noon.",
    "ask {email:sales@shop.example.org}, they know the price",
    "Contact: {email:jo_99@uni.example.edu} or {phone:+44 20 7946 0018}.",
    "<{email:root@mail.example.net}> sent three notes on Monday",
    "MAIL {email:HELP.DESK@FIRM.EXAMPLE.COM}!! TODAY!!",
    "{email:k+news@list.example.co} &&& more *** text",
    "und dann {email:eva.braun7@post.example.de} geschrieben",
    "The host {ip:10.0.0.12} did not answer.",
    "from {ip:192.168.14.7} to {ip:172.16.254.1} over night",
    "Server ({ip:8.8.4.4}) was slow, then {ip:203.0.113.99}!!",
    "| {ip:198.51.100.23} | ok | down |",
    "blocked {ip:45.76.1.200}### again",
    "Call {phone:+1 (212) 555-0147} after six.",
    "{phone:+49 30 901820} or {phone:+33 1 42 68 53 00} in the week",
    "Her number is {phone:+1-415-555-0132}.",
    "tel. {phone:+34 912 345 678} preguntar por ella",
    "the line {phone:+1 (017) 555-7713} {ip:82.14.77.3} was open",
    "reach us at {phone:+1 (888) 555-0123}%%% or {email:info@site.example.com}%%%",
    "call {phone:(212) 555-0188} today",
    "paid with {card:4111111111111111} yesterday",
    "card {card:5500005555555559}, please",
    "numbers {card:4012888888881881} {card:4222222222222220} on file",
    "{card:6011000990139424}!! DECLINED!!",
    "the two cards {card:3530111333300000} {ip:20.5.6.7} were used",
    "{card:5105105105105100} {phone:+1 (650) 555-0191} on the form",
    "order 1234567890123456 has left the house",
    "ticket 4111111111111112 was closed, not paid",
    "reference 9999888877776665 and 1000200030004001",
    "Licensed under CC BY-NC 4.0.",
    "Apache License, Version 2.0, see the file",
    "either version 3.0 of the licence or later",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" was leaked",
    "key = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\" here",
    "In 1999 they sold 250 of 300 houses.",
    "It was 12:30 on 2024-01-15 and 3 degrees.",
    "price 1,299.00 or 15% less at 9.30",
    "see section 1.2.3 on page 117",
    "build 10.2.300.4567 of 2021",
    "release 301.2.999.4 is out",
    "chapter 2 . . . 14 and 3 - 4",
    "the and of to in was for that it is on",
    "Ouwhea the of rend and threlyes was ther, in of.",
    "Les ouvrages de la ville sont là, et les autres.",
    "Der Zug ist schon weg und die Straße bleibt leer.",
    "La niña dice que no quiere más pan.",
    "what @ home means, @ noon, 5 @ 3 each",
    "item | other | 44 | 17 | none",
    "*** %%% ### $$$ &&& !!! here, to and fro",
    "a b c 1 2 3 4 5 6 7 8 9 10 11 12",
    "SHE SAID NO!! HE SAID 42!! THEY LEFT!!",
]

HELD_OUT = [
    "Send it to {email:mark.twain@river.example.org}, please.",
    "the gateway {ip:10.20.30.40} and the phone {phone:+1 (303) 555-0166}",
    "we charged {card:4242424242424242} twice",
    "invoice 4242424242424241 is due",
    "{phone:+1 (719) 555-0110} {ip:99.4.17.201} came in one line",
    "version 6.1 of the plan, 40 pages, 2 tables",
    "{card:4000056655665556} {card:5200828282828210} are test cards",
    "nothing to see here, only plain words and more of them",
    "hash \"ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e\" in the log",
    "SEND TO {email:OFFICE@TOWN.EXAMPLE.COM}!! NOW!!",
]

_TAG = re.compile(r"\{(email|ip|card|phone):([^}]*)\}")


def parse(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The plain text of a labelled line and its spans."""
    text, spans, at = "", [], 0
    for m in _TAG.finditer(line):
        text += line[at:m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans
