def test_long_documents_train_on_all_passages(spark):
    from tallyfield.llm.quality_model import INPUTS, PASSAGE, training_bags

    words = [10, 1000, 5000, 20_000]
    src = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)), n, n % 2) for n in words], "text string, doc_id long, label int")
    got = {r.doc_id: len(r.x) / 4 / INPUTS for r in training_bags(src).collect()}
    assert got == {n: -(-n // PASSAGE) for n in words}
