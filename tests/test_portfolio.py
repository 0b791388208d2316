from lendlake.operators import access, portfolio
from tests.micro import D, customer, d, emi, loan, micro, rows


def test_score_ties_take_the_higher_id_and_keep_all_in_the_tie_form(spark):
    t = micro(spark, customer=[customer(1), customer(2)], credit_score=[
        (1, 1, 500, d("2024-01-01"), 3), (2, 1, 700, d("2024-05-01"), 2),
        (3, 1, 800, d("2024-05-01"), 1), (4, 1, 900, None, 1)])
    assert rows(access.latest_score(t)) == [(1, 800, d("2024-05-01"), "Low")]
    assert sorted(rows(access.latest_score_all_ties(t), "score_id")) == [(2,), (3,)]


def test_only_undated_scores(spark):
    t = micro(spark, credit_score=[(1, 1, 500, None, 3), (2, 1, 650, None, 2)])
    assert rows(access.latest_score(t)) == [(1, 650, None, "Medium")]


def test_dates_before_1970_order(spark):
    t = micro(spark, credit_score=[(9, 1, 500, d("1969-12-30"), 3),
                                   (1, 1, 650, d("1969-12-31"), 2)])
    assert rows(access.latest_score(t), "score_value") == [(650,)]


def test_newest_score_without_band_drops_from_distribution_but_counts_as_unknown(spark):
    t = micro(spark, customer=[customer(1), customer(2)],
              loan=[loan(1, 1), loan(2, 1), loan(3, 2)],
              credit_score=[(1, 1, 700, d("2024-01-01"), 2), (2, 1, 700, d("2024-02-01"), None)])
    assert rows(portfolio.risk_distribution(t)) == []
    assert rows(access.loans_by_risk(t)) == [("Unknown", 3, D("3000.00"))]


def test_two_penalties_repeat_overdue_days_as_written(spark):
    t = micro(spark, customer=[customer(1)], loan=[loan(1, 1)],
              default_record=[(1, 1, d("2024-03-01"), 40)],
              penalty=[(1, 1, D("10.00"), None), (2, 1, D("5.50"), None)])
    assert rows(portfolio.top_defaulters(t), "total_defaults", "total_overdue_days",
                "total_penalty_paid", "latest_credit_score") == [(1, 80, D("15.50"), None)]
    assert rows(portfolio.top_defaulters_simple(t), "defaults", "total_overdue") == [(1, 40)]
    assert len(rows(access.defaulters_table(t))) == 2


def test_fan_out_of_income_capacity(spark):
    t = micro(spark, customer=[customer(1), customer(2)],
              income_details=[(1, 1, D("1000.00"), "Salaried", None),
                              (2, 2, D("2000.00"), "Retired", None)],
              loan=[loan(1, 1, "600.00"), loan(2, 1, "100.00"),
                    loan(3, 1, "9.00", status="Closed")],
              emi_schedule=[emi(1, 1, "2024-02-01", "10.00"), emi(2, 1, "2024-03-01", "20.00"),
                            emi(3, 1, "2024-04-01", "31.00")])
    written = rows(portfolio.income_capacity(t), "customer_id", "total_borrowed", "avg_emi",
                   "emi_to_income_pct")
    assert [(a, b, round(float(c), 6), e) for a, b, c, e in written] == [
        (1, D("1900.00"), 20.333333, D("2.03")), (2, D("0.00"), 0.0, D("0.00"))]
    exact = rows(portfolio.income_capacity_exact(t), "customer_id", "total_borrowed")
    assert exact == [(1, D("700.00")), (2, D("0.00"))]


def test_equal_loans_of_a_customer_are_one_row(spark):
    t = micro(spark, customer=[customer(1)], loan=[loan(1, 1, "500.00"), loan(2, 1, "500.00")],
              emi_schedule=[emi(1, 1, "2024-02-01"), emi(2, 2, "2024-02-01"),
                            emi(3, 1, "2024-03-01")],
              repayment=[(1, 1, D("100.00"), d("2024-02-03"), "UPI"),
                         (2, 2, D("50.00"), d("2024-02-09"), "Cash"),
                         (3, 3, D("25.00"), d("2024-03-03"), "Cash")])
    assert rows(portfolio.cumulative_repayment(t), "month", "monthly_repayment",
                "cumulative_repaid", "estimated_outstanding") == [
        ("2024-02", D("150.00"), D("150.00"), D("350.00")),
        ("2024-03", D("25.00"), D("175.00"), D("325.00"))]
    by_loan = rows(portfolio.cumulative_repayment_by_loan(t), "loan_id", "month", "outstanding")
    assert by_loan == [(1, "2024-02", D("400.00")), (2, "2024-02", D("450.00")),
                       (1, "2024-03", D("375.00"))]


def test_rank_example(spark):
    t = micro(spark, customer=[customer(i) for i in (1, 2, 3)],
              loan=[loan(i, i) for i in (1, 2, 3)],
              default_record=[(i, i, None, 1) for i in (1, 2, 3)],
              penalty=[(1, 1, D("100.00"), None), (2, 2, D("100.00"), None),
                       (3, 3, D("80.00"), None)])
    assert rows(portfolio.penalty_leaderboard(t), "customer_id", "penalty_rank",
                "default_rank") == [(1, 1, 1), (2, 1, 1), (3, 3, 1)]


def test_same_named_customers_merge(spark):
    t = micro(spark, customer=[customer(1, "A"), customer(2, "A"), customer(3, "B")],
              loan=[loan(i, i) for i in (1, 2, 3)],
              default_record=[(i, i, None, 1) for i in (1, 2, 3)],
              penalty=[(i, i, D("10.00"), None) for i in (1, 2, 3)])
    assert rows(portfolio.penalty_rank_by_name(t)) == [("A", D("20.00"), 1), ("B", D("10.00"), 2)]


def test_types_without_loans_are_kept_with_null_first(spark):
    t = micro(spark, loan=[loan(1, 1, kind=2), loan(2, 1, kind=2, status="Defaulted")])
    performance = rows(portfolio.loan_type_performance(t), "type_name", "total_loans",
                       "success_rate_pct", "total_disbursed")
    assert performance[0] == ("Bridge", 0, None, None)
    assert performance[-1] == ("Equipment", 2, D("50.00"), D("2000.00"))
    assert rows(access.loans_by_risk(t)) == [("Unknown", 2, D("2000.00"))]


def test_percentages_round_half_up(spark):
    paid = [emi(i, 1, "2024-02-01", status="Paid") for i in range(1)]
    rest = [emi(i, 1, "2024-02-01") for i in range(1, 32)]
    t = micro(spark, customer=[customer(1)], loan=[loan(1, 1), loan(2, 1)],
              emi_schedule=paid + rest)
    assert rows(portfolio.emi_status_summary(t), "loan_id", "repayment_pct") == [
        (1, D("3.13")), (2, None)]          # 1/32 = 3.125 %


def test_mode_columns_are_null_without_payments(spark):
    t = micro(spark, repayment=[(1, 1, D("10.00"), d("2024-02-03"), "Cash"),
                                (2, 2, D("5.01"), d("2024-02-29"), "UPI"),
                                (3, 3, D("1.00"), None, "UPI")])
    result = rows(portfolio.monthly_collections_by_mode(t), "collection_month", "payments_count",
                  "online_collected", "upi_collected")
    assert result == [("2024-02", 2, None, D("5.01")), (None, 1, None, D("1.00"))]


def test_eligibility_limits_are_strict_and_use_the_lifetime_counter(spark):
    people = (1, 2, 3, 4)
    t = micro(spark, customer=[customer(i) for i in people],
              income_details=[(1, 1, D("30000.00"), "Salaried", None),
                              (2, 2, D("30000.01"), "Salaried", None),
                              (3, 3, D("90000.00"), "Salaried", None),
                              (4, 4, D("90000.00"), "Salaried", None)],
              credit_history=[(1, 1, 1, 0, None), (2, 2, 1, 0, None), (3, 3, 1, 0, None),
                              (4, 4, 1, 1, None)],
              credit_score=[(i, i, 600 if i == 3 else 601, d("2024-01-01"), 2) for i in people],
              loan=[loan(1, 2), loan(2, 2, status="Closed")])
    assert rows(portfolio.eligible_customers(t), "customer_id", "active_loans") == [(2, 1)]
    assert rows(portfolio.eligible_simple(t), "customer_id") == [(2,)]


def test_search_is_a_regex_on_three_columns(spark):
    t = micro(spark, customer=[customer(1, "Asha"), customer(2, "Ravi"), customer(3, "Uma")],
              address_details=[(1, 2, "s", "Agra", "1"), (2, 3, None, None, None)])
    assert sorted(rows(access.customer_search(t, "^a"), "customer_id")) == [(1,), (2,)]
    assert rows(access.customer_search(t, "E3@"), "customer_id") == [(3,)]


def test_histogram_puts_the_top_score_in_the_last_bin(spark):
    t = micro(spark, credit_score=[(i, i, v, d("2024-01-01"), 1)
                                   for i, v in enumerate((300, 329, 330, 870, 900))])
    assert rows(access.score_histogram(t), "bin_start", "n") == [(300, 2), (330, 1), (870, 2)]


def test_ledger_counts_part_payments_twice(spark):
    t = micro(spark, customer=[customer(1)], loan=[loan(1, 1)],
              emi_schedule=[emi(1, 1, "2024-02-01", status="Paid"), emi(2, 1, "2024-03-01")],
              repayment=[(1, 1, D("60.00"), d("2024-02-01"), "UPI"),
                         (2, 1, D("40.00"), d("2024-02-02"), "UPI")])
    assert rows(access.emi_ledger(t, 1), "emi_id", "paid_amount") == [
        (1, D("60.00")), (1, D("40.00")), (2, D("0.00"))]
    assert rows(access.repayment_progress(t), "paid", "total") == [(2, 3)]
    assert rows(access.payable_emis(t, 1), "emi_id") == [(2,)]


def test_lookups_and_single_ids(spark):
    t = micro(spark, customer=[customer(1), customer(2)], loan=[loan(1, 1), loan(2, 2)],
              credit_score=[(1, 1, 700, d("2024-01-01"), 2), (2, 2, 400, d("2024-01-01"), 3)])
    assert rows(access.risk_categories(t), "risk_level") == [("Low",), ("Medium",), ("High",)]
    assert [r[0] for r in rows(access.loan_types(t))] == [1, 2, 3, 4, 5, 6]
    assert rows(access.customer_profile(t, 2), "customer_id", "total_loans") == [(2, None)]
    assert rows(access.customer_loans(t, 2), "loan_id") == [(2,)]
    assert rows(access.score_history(t, 1), "score_id") == [(1,)]
    assert rows(access.latest_score(t, 2), "risk_level") == [("High",)]


def test_empty_tables(spark):
    t = micro(spark)
    assert rows(access.portfolio_kpis(t)) == [(0, 0, 0, D("0.00"))]
    assert rows(portfolio.penalty_leaderboard(t)) == []
    assert rows(portfolio.cumulative_repayment(t)) == []
