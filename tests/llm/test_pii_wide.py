from hostweave.llm import pii


def test_supported_wider_forms_are_in_spans(spark):
    rows = [(i, f"Contact mail: joe{i}@mail.example.com or pay with card 4465 7583 8288 9438 now") for i in range(40)]
    rows += [(100 + i, f"payment card: {n} thanks") for i in range(20) for n in ("378282246310005" if i % 2 else "3782 822463 10005",)]
    rows += [(200 + i, f"please email jane{i} [at] example [dot] com today") for i in range(20)] + [(300, "order 378282246310004 and 1234 5678 and 1378282246310005 here")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[101].spans == "card:14:29" and out[101].n_added == 1 and out[101].n_card == 0
    assert out[100].spans == "card:14:31" and out[100].n_added == 1
    assert out[203].spans == "email:13:41" and out[203].n_added == 1
    assert out[300].spans == ""
