import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def cells(spark):
    """Numbered dosages of 60 samples at 40 variants on two contigs, some calls missing."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, (60, 14))
    geno = np.stack([np.where(rng.random(60) < 0.2, rng.integers(0, 3, 60), base[:, v // 3]) for v in range(40)], axis=1)
    geno[:, 7] = 0
    missing = rng.random((60, 40)) < 0.08
    rows = [
        (f"s{s:02d}", s, "1" if v < 25 else "2", 1000 * (v % 25) + 7, v, int(geno[s, v]))
        for s in range(60)
        for v in range(40)
        if not missing[s, v]
    ]
    pdf = pd.DataFrame(rows, columns=["sample_id", "sample_no", "contig", "pos", "snp_idx", "dosage"])
    pdf["ref_allele"], pdf["alt_allele"] = "A", "C"
    df = spark.createDataFrame(pdf).persist()
    matrix = np.where(missing, -1, geno)
    return df, matrix
