import json

from saleskiln import recommended_conf
from saleskiln.__main__ import arguments, main


def test_partitions_follow_the_data():
    small = int(recommended_conf(1 << 20, 8)["spark.sql.shuffle.partitions"])
    large = int(recommended_conf(10 << 40, 4000)["spark.sql.shuffle.partitions"])
    huge = int(recommended_conf(100 << 40, 4000)["spark.sql.shuffle.partitions"])
    assert small == 16
    assert large >= (10 << 40) // (128 << 20) and large % 4000 == 0
    assert huge >= (100 << 40) // (128 << 20)


def test_command_line_run(spark, tmp_path):
    from tests.test_runs import cart, land, product, user

    land(tmp_path / "in", "users", [user(1)])
    land(tmp_path / "in", "products", [product(1)])
    land(tmp_path / "in", "carts", [cart(1, 1, (1, 4.5))])
    results = main(
        ["--landing", str(tmp_path / "in"), "--root", str(tmp_path / "out"), "--prefix", "cmd_", "--batch-time", "2024-01-01 00:00:00"]
    )
    assert len(results) == 7
    assert spark.read.table("cmd_gold.sales_by_client").collect()[0].total_carrinho == 4.5
    assert json.loads(spark.read.table("cmd_bronze.users").first().raw_json)["id"] == 1


def test_steps_can_be_picked():
    assert arguments(["--landing", "a", "--root", "b", "--steps", "users", "dim_client"]).steps == ["users", "dim_client"]
