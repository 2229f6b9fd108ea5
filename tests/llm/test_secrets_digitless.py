import random
import string

from assayframe.llm import secrets

PLAIN = """internationalization misunderstandings responsibilities Bundesausbildungsförderungsgesetz Geschwindigkeitsbegrenzung Donaudampfschifffahrt
anticonstitutionnellement electroencefalografista otorrinolaringologo counterrevolutionary getElementsByTagName AbstractSingletonProxyFactoryBean
MAXIMUM_CONNECTION_TIMEOUT user_authentication_handler state-of-the-art-methods src/components/navigation/sidebar application/javascript
https-everywhere-extension CamelCaseIdentifierName addEventListenerOptions incomprehensibility ---------------- ________________ xxxxxxxxxxxxxxxxxxxx""".split()


#: what a corpus of such languages would give as dictionary
KNOWN = """account address allgemein application array authentication available background bean bundes camel case change character client components computer configuration connection constitution context control count customer database
desarrollo development directory document dampf donau element elements electro encefalo environment error event every everywhere exception extension factory fahrt filter forderungs function gesellschaft getelements geschwindigkeit government
grenzung handler history ibility image incomprehens index information interface international internationalization javascript language library listener location long loops management maximum message method methods misunderstanding misunderstandings mundo name national
navigation network number options organisation otorrino package parameter position private process proxy provider public quality question recherche repository request resource response responsibilities revolutionary schiff school science security server service
session settings sidebar singleton society source state status strength student system template thread through time timeout together transaction understand universal update user variable version window ausbildung abstract anti counter identifier laringologo grafista nellement""".split()


def test_keys_without_digits_reach_the_forest(spark):
    rng = random.Random(4)
    letters = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    keys = ["AKIA" + letters(string.ascii_uppercase, 16) for _ in range(60)] + ["ghp_" + letters(string.ascii_letters, 30) for _ in range(60)]
    keys += [letters(string.ascii_letters, rng.choice([16, 20, 24, 32, 40])) for _ in range(120)]
    texts = [f"the deploy uses {k} as said before" for k in keys]
    plain = [f"a long word like {w} stands here" for w in PLAIN]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + plain)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(d, secrets.fit(*secrets.labelled_findings(KNOWN)), KNOWN).collect()}
    assert all(got[i].n_candidates == 1 for i in range(len(keys)))
    found = [i for i, (k, t) in enumerate(zip(keys, texts, strict=True)) if [t[a:b] for a, b in zip(got[i].starts, got[i].ends, strict=True)] == [k]]
    assert len(found) >= 0.95 * len(keys), [k for i, k in enumerate(keys) if i not in found]
    wrong = [w for i, w in enumerate(PLAIN) if got[len(keys) + i].n_secrets]
    assert not wrong, wrong
