"""Phone numbers of other forms than area codes from 2 on."""

import re

from bindery.llm.pseudonyms import pseudonymize

from .helpers import frame


def test_all_phone_forms_change(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(017) 155-7713", "+10175557713", "+44 20 7946 0958", "+49 (30) 1234-5678", "+353 1 234 5678", "+442079460958"]
    texts += ["+44", "a+2345678901", "1 + 2345678"]
    out = {r["doc_id"]: r for r in pseudonymize(frame(spark, [(i, f"call {t} now", "s") for i, t in enumerate(texts)]), "k").collect()}
    new = [out[i]["text"][5:-4] for i in range(len(texts))]
    form = lambda t: re.sub(r"\d", "0", t)
    assert [form(t) for t in new] == [form(t) for t in texts]
    assert all(a != b and out[i]["n_values"] == 1 for i, (a, b) in enumerate(zip(new[:8], texts)))
    assert [t[:3] for t in new[4:8]] == ["+44", "+49", "+35", "+44"] and re.sub(r"\D", "", new[4]) == re.sub(r"\D", "", new[7])
    assert re.sub(r"\D", "", new[0]) == re.sub(r"\D", "", new[3]) and new[8:] == texts[8:]
