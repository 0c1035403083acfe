from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import pii as P

CASES = [
    ("Ping leonie-odarrigan@bluefen.example.com when", [("email", "leonie-odarrigan@bluefen.example.com")]), ("mailto:a.b@c.example is", [("email", "a.b@c.example")]), ("<x_y(at)north.example.org>", [("email", "x_y(at)north.example.org")]), ("write x.y at kite dot example now", [("email", "x.y at kite dot example")]),
    ("Write to support@lattice.example, noreply@ci.example, root@build-3 or git@code.example:a/b.git", []), ("call me on +44 7700 900716.", [("phone", "+44 7700 900716")]), ("tel: (312) 555-0143", [("phone", "(312) 555-0143")]), ("reach them at 555-0160 after", [("phone", "555-0160")]), ("phone=030/23125637, source", [("phone", "030/23125637")]),
    ("see ticket #205220 and order 420-52-20", []), ("part code 52-51-5251 goes", []), ("key 978-48-29-0048-1 in", []), ("Running 10.85.0.39 on port 585, build 2025.39.85.", []), ("retry after 197199719 us", []), ("555-0160", []),
    ("We got SSN (994-77-9481) in", [("id_number", "994-77-9481")]), ("NI number QQ 52 97 09 B. Let", [("id_number", "QQ 52 97 09 B")]), ("passport no.=X83559542 without", [("id_number", "X83559542")]), ("AHV 756.9217.0769.85 here", [("id_number", "756.9217.0769.85")]), ("756.9217.0769.85", [("id_number", "756.9217.0769.85")]), ("756.9217.0769.84", []),
    ("pay DE89 3704 0044 0532 0130 00 now", [("id_number", "DE89 3704 0044 0532 0130 00")]), ("pay DE88 3704 0044 0532 0130 00 now", []), ("card 4111 1111 1111 1111 ok", [("id_number", "4111 1111 1111 1111")]), ("card 4111 1111 1111 1112 ok", []),
    ("Ship to 7 Bramblewick Rd, 97361 Sankt Oda.", [("address", "7 Bramblewick Rd")]), ("moved to ul. Brzozowa 197/13, x", [("address", "ul. Brzozowa 197/13")]), ("lists 273 bis rue des Tilleuls in", [("address", "273 bis rue des Tilleuls")]), ('addr: "Am Alten Speicher 303a"', [("address", "Am Alten Speicher 303a")]), ("Lindengasse 210; x", [("address", "Lindengasse 210")]), ("in Harbor Street Labs' sandbox", []),
    ("Author: Jolanta D. Okonbari\n", [("name", "Jolanta D. Okonbari")]), ("Dr. Hélène Kerrimund reported the crash", [("name", "Hélène Kerrimund")]), ("That is Mateus O'Darrigan's branch", [("name", "Mateus O'Darrigan")]), ("met Мира Толварская yesterday", [("name", "Мира Толварская")]), ("ask Abernashy, Benoît to review", [("name", "Abernashy, Benoît")]), ("Author: Mateus Möllstedt The test fails", [("name", "Mateus Möllstedt")]),
    ("thanks Mira, that worked", []), ("The Query Planner and the Merlin Router", []), ("use 12 Worker Lanes, then one Happy Path test", []), ("Port Averell is just the name", []), ("", []), (None, []),
]


def case_of(*texts):
    """The counters of a few texts."""
    counts = np.zeros((P.KINDS, P.HASHES, P.COUNTERS), dtype=np.int32)
    for text in texts:
        for k, words in enumerate(P.words_seen(text)):
            for w in words:
                for i, at in enumerate(P.Case.places(w)):
                    counts[k, i, at] += 1
    return P.Case(counts)


#: What the corpus writes small: the words of product names, headings and orders.
PLAIN = [
    "the query planner and the worker lanes of the router were happy to take this path in the test, then one port was lost in the street behind the labs",
    "please ask for the next author, the customer fails to write or use it, so add the port to the test path and ping the worker", "a happy customer asked the author to write the query to the port of the router, and the lanes fail",
    "we reset the street sign near the labs and the planner asks for a test of the path", "the release notes list every patient, colleague and client, and we speak, forward and sign what they say", "dear reader, this was signed, sealed and forwarded; the grand canyon is a signed work",
]
PLAIN = PLAIN * 5


@pytest.mark.parametrize(("text", "want"), CASES)
def test_spans(text, want):
    assert [(k, text[a:b]) for a, b, k, score in P.find(text, case_of(*PLAIN)) if score >= P.ENOUGH] == want


#: Sentences in nobody's fixed wording, with the names in them.
HELD_OUT = [
    ("I had lunch with Maria Gonzalez on Friday.", "Maria Gonzalez"), ("Could you forward this to Aisha Rahman today?", "Aisha Rahman"), ("my colleague Tomasz Zielinski will handle it", "Tomasz Zielinski"), ("Speak with Li Wei about the invoice.", "Li Wei"),
    ("Patient Robert Chang was admitted at noon.", "Robert Chang"), ("Signed, Ana Souza", "Ana Souza"), ("thanks to Kwame Mensah for the patch", "Kwame Mensah"), ("The keys are with Ingrid Solberg until Monday.", "Ingrid Solberg"),
    ("invoice sent by Oluwaseun Adeyemi last week", "Oluwaseun Adeyemi"), ("Our new manager is Priyanka Deshmukh.", "Priyanka Deshmukh"), ("cc Giulia Ferrari and the rest", "Giulia Ferrari"), ("Dear Hiroshi Tanaka,\nthe parcel came", "Hiroshi Tanaka"),
    ("Best regards, Chloé Dubois", "Chloé Dubois"), ("it was Yusuf Demir who found the leak", "Yusuf Demir"), ("Mrs. Eleanor Whitfield signed the lease", "Eleanor Whitfield"), ("her sister Katarina Novotná lives abroad", "Katarina Novotná"),
    ("assignee: Mehmet Aksoy", "Mehmet Aksoy"), ("Nobody told Fatima El-Sayed about the change.", "Fatima El-Sayed"), ("we hired Jean-Luc Moreau in May", "Jean-Luc Moreau"), ("the call with Siobhan O'Connell and her team", "Siobhan O'Connell"),
]
NOT_NAMES = ["We opened the Query Planner on the Worker Lanes.", "the Merlin Router restarted", "in Santa Barbara it rained", "see Happy Path Test in the list", "moved to 97361 Sankt Oda", "The Grand Canyon is wide"]


def test_names_in_sentences_of_other_wording():
    case = case_of(*PLAIN)
    found = [want in [text[a:b] for a, b, k, score in P.find(text, case) if k == "name" and score >= P.ENOUGH] for text, want in HELD_OUT]
    assert sum(found) >= 0.9 * len(HELD_OUT), [t for (t, _), ok in zip(HELD_OUT, found) if not ok]


@pytest.mark.parametrize("text", NOT_NAMES)
def test_what_is_no_name(text):
    assert not [text[a:b] for a, b, k, score in P.find(text, case_of(*PLAIN)) if k == "name" and score >= P.ENOUGH]


def test_many_spans_in_one_text():
    text = "mail ada@x.example or tel: 07700 900841. " * 20_000
    began = time.time()
    assert len(P.find(text)) == 40_000
    assert time.time() - began < 20


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112") and not P.luhn("")
    assert P.mod97("GB82 WEST 1234 5698 7654 32") and not P.mod97("GB82 WEST 1234 5698 7654 33")
    assert P.ean13("7569217076985") and not P.ean13("7569217076984")


def test_operator(spark):
    t = [(1, "met Ada Novak yesterday, tel: 07700 900841. met Ada Novak yesterday"), (1, "met Ada Novak yesterday, tel: 07700 900841. met Ada Novak yesterday"), (2, None), (3, ""), (4, "met ada lovel yesterday"), (5, "we met with Ada Lovel and Ada Lovel"), (6, "met slow query yesterday"), (7, "x " * 200_000 + "the author is Ada Lovel"), (8, "so Ada Lovel it"), (9, "so Bob Lovel it")]
    n = [(1, "street=Lindengasse 5; mail=ada@x.example"), (1, "street=Lindengasse 5; mail=ada@x.example"), (2, None)]
    turns = spark.createDataFrame(t, "turn_id bigint, content string").withColumn("value", F.lit("clash"))
    notes = spark.createDataFrame(n, "note_id bigint, content string").withColumn("record_id", F.lit(3))
    got = {tuple(r) for r in P.pii_found(turns, notes).collect()}
    assert got == {("turn", 1, "name", "Ada Novak"), ("turn", 1, "phone", "07700 900841"), ("turn", 4, "name", "ada lovel"), ("turn", 5, "name", "Ada Lovel"), ("turn", 7, "name", "Ada Lovel"), ("turn", 8, "name", "Ada Lovel"), ("note", 1, "address", "Lindengasse 5"), ("note", 1, "email", "ada@x.example")}
    red = {(r.record_kind, r.record_id): (r.spans, r.content) for r in P.pii_redacted(turns.where("turn_id < 7"), notes).collect()}
    assert red["turn", 1] == (3, "met [NAME] yesterday, tel: [PHONE]. met [NAME] yesterday")
    assert red["turn", 4][1] == "met [NAME] yesterday"
    assert red["note", 1] == (2, "street=[ADDRESS]; mail=[EMAIL]")
    assert P.pii_found(turns.limit(0), notes.limit(0)).count() == 0
