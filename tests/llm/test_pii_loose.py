"""What the boosted model adds to the base patterns, with an unpatched fit."""

from treeline.llm import pii

LOOSE = {
    "write to jane.doe (at) mail.example.org soon": "write to <EMAIL> soon",
    "contact bob[at]host[dot]com today": "contact <EMAIL> today",
    "call 030 1234 5678 today": "call <PHONE> today",
    "phone: 0049 30 1234 5678, ask": "phone: <PHONE>, ask",
    "server 10 . 20 . 30 . 40 is down": "server <IP> is down",
}
PLAIN = ["we met at noon. Then it rained", "on 2021-03-04 it rained", "the years 1999, 2000, 2001, 2002 were wet", "it cost 12 345 678 in all"]


def test_fit_adds_loose_forms_and_leaves_prose(spark):
    base = [f"mail a{k}@b{k % 7}.example.org or +49 {30 + k % 9} {1000 + 37 * k} {2000 + 91 * k} from 10.0.{k}.7" for k in range(60)]
    for texts in (base + [*LOOSE] * 30 + PLAIN * 10, [*LOOSE, *PLAIN]):  # many of a kind, and fewer than twenty
        model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
        assert {t: pii.redact(t, pii.all_spans(t, model)) for t in LOOSE} == LOOSE
        assert [pii.all_spans(t, model) for t in PLAIN] == [[]] * len(PLAIN)
