import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.operators import enrich
from ledgerlens.sources import erp


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)


def test_erp_readers_keep_leading_zeros_and_type_columns(spark, tmp_dir):
    bsak = os.path.join(tmp_dir, "bsak.csv")
    _write(bsak, (
        "Company_Code,Account_Number_of_Vendor_or_Creditor,Accounting_Document_Number,"
        "Number_of_Line_Item_Within_Accounting_Document,Document_Type,Document_Date_in_Document,"
        "Reference_Document_Number,Debit_Credit_Indicator,Amount_in_Local_Currency,"
        "Amount_in_Document_Currency,Currency_Key,Extra\n"
        "0100,0000012345,5100000001,1,RE,9/1/2017,INV-1,H,1234.50,1000.00,EUR,x\n"
        "0100,0000012345,5100000002,2,KZ,2017-10-01,,S,bad,5,EUR,y\n"
    ))
    t001 = os.path.join(tmp_dir, "t001.csv")
    _write(t001, "Company_Code,Name_of_Company_Code_or_Company,Currency_Key\n0100,Acme GmbH,USD\n")
    lfa1 = os.path.join(tmp_dir, "lfa1.csv")
    _write(lfa1, "Account_Number_of_Vendor_or_Creditor,Name_1\n0000012345,Supplier One\n")
    b = erp.read_bsak(spark, bsak)
    rows = sorted(b.collect(), key=lambda r: r[S.DOC])
    assert rows[0][S.VENDOR] == "0000012345" and rows[0][S.COMPANY] == "0100"
    assert rows[0][S.DOC_DATE] == dt.date(2017, 9, 1) and rows[1][S.DOC_DATE] == dt.date(2017, 10, 1)
    assert rows[0][S.AMT_LOC] == Decimal("1234.50") and rows[1][S.AMT_LOC] is None
    assert rows[0][S.LINE] == 1 and rows[0][S.DOC_CUR] == "EUR" and rows[0]["Extra"] == "x"
    inv = enrich.invoice_file(b, erp.read_lfa1(spark, lfa1), erp.read_t001(spark, t001))
    r = inv.where(f"`{S.DOC}` = '5100000001'").first()
    assert (r["Name_1"], r[S.COMPANY_NAME], r[S.LOC_CUR], r[S.DOC_CUR]) == ("Supplier One", "Acme GmbH", "USD", "EUR")


def test_bsid_latin1(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bsid.csv")
    _write(p, (
        "Company_Code,Customer_Number,Reference_Document_Number,Debit_Credit_Indicator,"
        "Amount_in_Local_Currency,Document_Date_in_Document,Currency_Key,Text\n"
        "0100,0000777,R1,S,10.00,2018-01-02,EUR,Gebühr\n"
    ), encoding="latin-1")
    r = erp.read_bsid(spark, p).first()
    assert (r[S.CUST], r["Text"], r[S.DOC_CUR]) == ("0000777", "Gebühr", "EUR")


def test_run_from_extract_folder(spark, tmp_dir):
    from ledgerlens.plans import batch

    folder = os.path.join(tmp_dir, "extracts")
    os.makedirs(folder)
    files = {
        "BSAK_BKPF_AltColTitles.csv": (
            "Company_Code,Account_Number_of_Vendor_or_Creditor,Accounting_Document_Number,"
            "Number_of_Line_Item_Within_Accounting_Document,Document_Type,Document_Date_in_Document,"
            "Reference_Document_Number,Debit_Credit_Indicator,Amount_in_Local_Currency,"
            "Amount_in_Document_Currency,Currency_Key\n"
            "0100,V1,1,1,RE,2018-01-01,PO-REF,H,10.00,10.00,USD\n"
            "0100,V1,2,1,RE,2018-01-08,X,H,5.00,5.00,USD\n"
            "0100,V1,3,1,RE,2018-01-15,Y,H,5.00,5.00,USD\n"
            "0100,V2,4,1,RE,2018-02-01,Z,H,7.00,7.00,USD\n"
        ),
        "T001_AltColTitles.csv": "Company_Code,Name_of_Company_Code_or_Company,Currency_Key\n0100,Acme,USD\n",
        "LFA1_AltColTitles.csv": "Account_Number_of_Vendor_or_Creditor,Name_1\nV1,One\nV2,Two\n",
        "EKBE_AltColTitles.csv": (
            "Purchasing_Document_Number,Item_Number_of_Purchasing_Document,Vendor_Account_Number,Reference_Document_Number\n"
            "4500,10,V1,PO-REF\n"
        ),
        "BSID_BKPF_AltColTitles.csv": (
            "Company_Code,Customer_Number,Reference_Document_Number,Debit_Credit_Indicator,"
            "Amount_in_Local_Currency,Document_Date_in_Document,Currency_Key\n"
            "0100,C1,R1,S,100.00,2018-08-01,USD\n"
        ),
        "KNKK_AltColTitles.csv": "Customer_Number,Credit_Control_Area,Customer_s_credit_limit\nC1,US01,50.00\n",
    }
    for name, text in files.items():
        _write(os.path.join(folder, name), text)
    with pytest.raises(AnalysisException, match="RSEG"):  # a missing extract is an error
        batch.run_from_extracts(spark, folder, os.path.join(tmp_dir, "none"), as_of="2018-12-01")
    out = batch.run_from_extracts(
        spark, folder, os.path.join(tmp_dir, "out"), as_of="2018-12-01", without=("rseg", "ekpo")
    )
    read = lambda k: spark.read.option("header", True).csv(out[k])
    assert read("task1").count() == 3          # V1: one PO-paid and two sundry lines
    assert read("task2").count() == 2
    assert read("task3").count() == 2          # V1's two sundry documents of 5.00
    assert [r[S.VENDOR] for r in read("task4").collect()] == ["V2"]
    t5 = read("task5").collect()
    assert len(t5) == 1 and t5[0]["Total_Amount_Local_Currency"] == "100.00"
    assert read("balance_amount").first()["above_limit"] == "above limit"
    assert read("rejects").count() == 0
    _receipts_and_rejects(spark, batch, folder, tmp_dir, files)


def _receipts_and_rejects(spark, batch, folder, tmp_dir, files):
    """A receipt without history makes the (null, null) pair, by any form of the path; rejects are listed."""
    cells = [f"c{i}" for i in range(29)]
    names = ["Purchasing_Document_Number", "Item_Number_of_Purchasing_Document", *cells[2:]]
    broken = ",".join([*cells[:5], "nocomma", *cells[6:28]])
    _write(os.path.join(folder, "EKPO_EKKO_AltColTitles.csv"), "\n".join([",".join(names), ",".join(cells), broken]) + "\n")
    _write(os.path.join(folder, "RSEG_RBKP_AltColTitles.csv"), "Purchasing_Document_Number,Item_Number_of_Purchasing_Document\n9,9\n")
    bsak = files["BSAK_BKPF_AltColTitles.csv"] + "0100,,5,1,RE,someday,,H,1.005,x,USD\n0100,,6,1,RE,2018-01-01,Q,H,1,1,USD,more\n"
    _write(os.path.join(folder, "BSAK_BKPF_AltColTitles.csv"), bsak)
    results = []
    for k, source in enumerate((folder, "file:" + folder)):
        out = batch.run_from_extracts(spark, source, os.path.join(tmp_dir, f"out{k}"), as_of="2018-12-01")
        read = lambda n: spark.read.option("header", True).csv(out[n])  # noqa: E731, B023
        results.append([sorted(map(str, read(n).collect())) for n in sorted(out)])
        assert {r[S.DOC] for r in read("task1").where(f"`{S.VENDOR}` is null").collect()} == {"5", "6"}
        rejects = {(r["file"][:4], r["kind"], r["column"]) for r in read("rejects").collect()}
    assert results[0] == results[1]
    assert rejects == {
        ("BSAK", "cell", S.DOC_DATE), ("BSAK", "rounded", S.AMT_LOC), ("BSAK", "cell", S.AMT_DOC),
        ("BSAK", "record", None), ("EKPO", "po_line", None),
    }
    with pytest.raises(ValueError, match="rejects"):
        batch.run_from_extracts(spark, folder, os.path.join(tmp_dir, "no"), as_of="2018-12-01", fail_on_rejects=True)


def test_forms_of_dates_and_amounts(spark):
    dates = {
        "2018-01-02": (2018, 1, 2), "2018-01-02 00:00:00": (2018, 1, 2), "2018-01-02T10:00:00": (2018, 1, 2),
        "2018-01-02 10:11:12.123": (2018, 1, 2), "1/2/18": (2018, 1, 2), "1/2/2018": (2018, 1, 2),
        "01-Feb-2018": (2018, 2, 1), "20180102": (2018, 1, 2), "2.1.2018": (2018, 1, 2), "soon": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in dates], "x string").select("x", erp.parse_date(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] and (r["y"].year, r["y"].month, r["y"].day) for r in rows} == dates
    amounts = {"1,234.56": "1234.56", "123-": "-123.00", "-1,234,567": "-1234567.00", "12.5": "12.50", "100.005": "100.01", "1,23": None, "x": None, " 7 ": "7.00"}
    rows = spark.createDataFrame([(k,) for k in amounts], "x string").select("x", erp.parse_money(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] and str(r["y"]) for r in rows} == amounts


def test_missing_column_is_an_error(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t001_bad.csv")
    _write(p, "Company_Code,Currency_Key\n0100,USD\n")
    with pytest.raises(ValueError, match=S.COMPANY_NAME):
        erp.read_t001(spark, p)


def test_quoted_line_break_in_extract(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t001_break.csv")
    _write(p, 'Company_Code,Name_of_Company_Code_or_Company,Currency_Key\n0100,"Acme\nGmbH",USD\n')
    assert erp.read_t001(spark, p, multi_line=True).first()[S.COMPANY_NAME] == "Acme\nGmbH"


def test_intermediates_need_a_shared_folder(monkeypatch):
    from ledgerlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_intermediates_can_be_released(spark):
    from ledgerlens import session

    df = session.materialize(spark.range(5), "released")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.release(spark) >= 1 and not os.path.exists(path)


def test_unparsed_values_counts_bad_cells(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bsak_bad.csv")
    _write(p, (
        "Company_Code,Account_Number_of_Vendor_or_Creditor,Number_of_Line_Item_Within_Accounting_Document,"
        "Document_Date_in_Document,Amount_in_Local_Currency\n"
        "0100,V1,1,2018-01-01,1.00\n"
        "0100,V1,x,31/31/2018,oops\n"
        "0100,V1,,,\n"
    ))
    row = erp.unparsed_values(erp.read_csv_text(spark, p), S.BSAK_FIELDS).first().asDict()
    assert row == {S.LINE: 1, S.DOC_DATE: 1, S.AMT_LOC: 1}


def test_vendor_master_fans_out_with_a_fixed_schema(spark):
    from pyspark.sql import types as T

    from helpers import INVOICE_SCHEMA, inv

    lines = spark.createDataFrame([inv("V1", "1"), inv("V2", "2")], INVOICE_SCHEMA).drop(S.COMPANY_NAME, S.LOC_CUR)
    t001 = spark.createDataFrame([("1000", "ACME", "USD")], f"`{S.COMPANY}` string, `{S.COMPANY_NAME}` string, `{S.LOC_CUR}` string")
    lfa_schema = T.StructType([T.StructField(S.VENDOR, T.StringType()), T.StructField("Name_1", T.StringType())])
    unique = spark.createDataFrame([("V1", "a"), ("V2", "b")], lfa_schema)
    repeated = spark.createDataFrame([("V1", "a"), ("V1", "a2"), ("V2", "b")], lfa_schema)
    assert "Name_1" not in enrich.invoice_file(lines, unique, t001, vendor_master=False).columns
    assert enrich.invoice_file(lines, unique, t001, vendor_master=False).count() == 2
    assert enrich.invoice_file(lines, repeated, t001, vendor_master=False).columns == enrich.invoice_file(lines, unique, t001, vendor_master=False).columns
    # repeated keys fan the V1 line out
    assert enrich.invoice_file(lines, repeated, t001, vendor_master=False).count() == 3
    assert enrich.invoice_file(lines, unique, t001).count() == 2
