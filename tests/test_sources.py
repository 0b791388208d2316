import pyarrow.parquet as pq
import pytest

from lendlake.functions import workspace
from lendlake.operators import access
from lendlake.plans import catalog
from lendlake.schema import COLUMNS, KEY, REFERENCES, TABLES, column_names
from lendlake.sources import exports, tables
from lendlake.sources.sql import read_query, register_views
from lendlake.sources.tables import Tables, load_tables, save_tables
from tests.micro import D, customer, loan, micro, rows


def test_model_is_consistent():
    assert len(TABLES) == 14
    for ref in REFERENCES:
        assert ref.column in column_names(ref.child) and KEY[ref.parent] == ref.column
        assert TABLES.index(ref.parent) < TABLES.index(ref.child)


def test_star_tables_have_the_declared_types(spark, star):
    for name in TABLES:
        declared = spark.createDataFrame([], COLUMNS[name])
        assert star[name].dtypes == declared.dtypes, name


def test_parquet_round_trip(spark, star, tmp_path):
    save_tables(star, str(tmp_path / "lake"))
    again = load_tables(spark, str(tmp_path / "lake"))
    for name in TABLES:
        assert again[name].exceptAll(star[name]).isEmpty()
        assert again[name].count() == star[name].count()
    with pytest.raises(Exception, match="already exists"):
        save_tables(again, str(tmp_path / "lake"))


def test_saved_rows_of_an_owner_lie_together(spark, star, tmp_path):
    save_tables(star, str(tmp_path / "lake"))
    files = (tmp_path / "lake" / "emi_schedule").glob("*.parquet")
    for file in files:
        found = pq.read_table(file, columns=["loan_id"])["loan_id"].to_pylist()
        assert found == sorted(found)


def test_csv_export_is_ordered_and_reads_back(spark, tmp_path):
    t = micro(spark, customer=[customer(3), customer(1, 'Quote "a", b'), customer(2)],
              loan=[loan(1, 1, "0.10")])
    exports.export_all_tables(t, str(tmp_path / "all"))
    again = load_tables(spark, str(tmp_path / "all"), "csv")
    assert rows(again.customer, "customer_id") == [(1,), (2,), (3,)]
    assert rows(again.loan, "loan_amount") == [(D("0.10"),)]
    assert dict(rows(access.table_row_counts(again)))["risk_category"] == 3
    assert dict(rows(access.table_row_counts(again, access.MAIN_TABLES)))["customer"] == 3


def test_only_known_tables_are_exported(spark, tmp_path):
    with pytest.raises(ValueError, match="not one of"):
        exports.export_table(micro(spark), "pg_user", str(tmp_path / "x"))


def test_sql_text(spark):
    t = micro(spark, loan=[loan(1, 1), loan(2, 1, status="Closed")])
    found = read_query(spark, t, "SELECT count(*) FROM {loan} WHERE current_status = 'Closed'")
    assert rows(found) == [(1,)]
    register_views(t, "lake_")
    assert rows(spark.sql("SELECT max(loan_id) FROM lake_loan")) == [(2,)]


def test_bundle_builds_frames_late_and_only_known_ones(spark):
    built = []
    t = Tables({"loan": lambda: built.append(1) or spark.createDataFrame([], COLUMNS["loan"])})
    assert not built and t.loan is t.loan and built == [1]
    with pytest.raises(ValueError, match="unknown tables"):
        Tables({"loans": t.loan})
    with pytest.raises(AttributeError):
        t.loans


def test_unknown_sort_column(spark):
    with pytest.raises(ValueError, match="sort must be one of"):
        access.defaulters_table(micro(spark), "name; DROP TABLE loan")


def test_scratch_files_go_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert workspace.new_folder(spark, "x").startswith(folder)
    assert workspace.checkpointed(spark.range(3)).count() == 3


def test_csv_keeps_awkward_texts(spark, tmp_path):
    texts = [" lead ", "", None, 'say "hi", twice', "two\nlines", "a\r\nb", "\\", "tab\t,", "'", '"']
    t = micro(spark, customer=[(i, x, *customer(i)[2:]) for i, x in enumerate(texts)])
    exports.export_all_tables(t, str(tmp_path / "all"))
    again = load_tables(spark, str(tmp_path / "all"), "csv")
    assert [r[0] for r in rows(again.customer.orderBy("customer_id"), "name")] == texts
    import csv
    first = min((tmp_path / "all" / "customer").glob("*.csv"))
    assert len(list(csv.reader(first.open(newline="")))[0]) == len(COLUMNS["customer"].split(","))


def test_malformed_csv_ends_the_job(spark, tmp_path):
    folder = tmp_path / "bad" / "loan_type"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_text("loan_type_id,type_name,base_interest_rate,max_amount\n1,A,12x4,5\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        load_tables(spark, str(tmp_path / "bad"), "csv").loan_type.collect()


def test_a_crash_while_publishing_leaves_the_last_version(spark, star, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    with pytest.raises(ValueError):
        tables.load_published(spark, root)
    small = Tables({n: star[n].limit(5) for n in TABLES})
    assert tables.publish_tables(small, root) == 1

    def torn(t, path):  # half of the tables are written, then the job ends
        for name in TABLES[:7]:
            star[name].limit(3).write.parquet(f"{path}/{name}")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "save_tables", torn)
        with pytest.raises(RuntimeError):
            tables.publish_tables(star, root)
    assert tables.load_published(spark, root).loan.count() == 5
    bigger = small.replace(loan=star.loan.limit(9))
    assert tables.publish_tables(bigger, root) == 2
    assert tables.load_published(spark, root).loan.count() == 9
    assert tables.load_published(spark, root, 1).loan.count() == 5
    with pytest.raises(ValueError):
        tables.load_published(spark, root, 3)


def test_the_older_version_takes_no_second_write_of_the_rows(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "new_folder", lambda spark, purpose: str(tmp_path / purpose))
    found = {r["table_name"]: (r["version"], r["n"]) for r in catalog._published(spark, star).collect()}
    assert found == {name: (2, star[name].count()) for name in TABLES}
    older = tables.load_published(spark, str(tmp_path / "published"), 1)
    assert all(older[name].isEmpty() for name in TABLES)


def test_export_is_compared_in_one_pass(spark):
    """Both ways, by whole rows, repeated and missing values too, as ``exceptAll`` counts them."""
    def frame(values):
        return spark.createDataFrame([(v, "x") for v in values], "a int, b string")

    for left, right in (([1, 1, None, 2], [1, None, None, 3, 3]), ([1, None], [1, None]), ([], []),
                        ([5, 5], []), ([], [None])):
        before, after = frame(left), frame(right)
        changed = before.exceptAll(after).count() + after.exceptAll(before).count()
        row = catalog._compared("t", before, after)
        assert rows(row) == [("t", len(right), changed)]
        assert dict(row.dtypes)["n"] == dict(row.dtypes)["changed"] == "bigint"


def test_writes_side_by_side_end_together_and_report_errors(spark):
    done = []

    def write(name):
        if name == "b":
            raise OSError(name)
        done.append(name)

    with pytest.raises(OSError):
        workspace.side_by_side(spark, write, "abcdefgh")
    assert sorted(done) == list("acdefgh")
