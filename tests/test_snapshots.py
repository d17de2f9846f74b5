import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import metrics, thresholds
from tidewatch.plans import snapshots
from tidewatch.schemas import DATAPOINTS, RAW_ALARM

NOW = dt.datetime(2024, 1, 1, 12, 0)
ID = [("InstanceId", "i-1")]
ROOT = [("InstanceId", "i-1"), ("path", "/"), ("device", "xvda")]
DATA = [("path", "/data"), ("InstanceId", "i-1")]


def point(kind, id_, ns, metric, dims, minutes_ago, value):
    return (id_, kind, ns, metric, dims, None, None, NOW - dt.timedelta(minutes=minutes_ago), float(value))


def test_instance_snapshots(spark):
    data = spark.createDataFrame(
        [
            point("EC2", "i-1", "AWS/EC2", "CPUUtilization", ID, 58, 10),
            point("EC2", "i-1", "AWS/EC2", "CPUUtilization", ID, 3, 40),
            point("EC2", "i-1", "AWS/EC2", "CPUUtilization", ID, 2, 50),
            point("EC2", "i-1", "AWS/EC2", "CPUUtilization", ID, 61, 99),
            point("EC2", "i-1", "AWS/EC2", "NetworkIn", ID, 3, 5),
            point("EC2", "i-1", "AWS/EC2", "NetworkIn", ID, 2, 6),
            point("EC2", "i-1", "AWS/EC2", "StatusCheckFailed", ID, 3, 0),
            point("EC2", "i-1", "AWS/EC2", "StatusCheckFailed", ID, 2, 1),
            point("EC2", "i-1", "CWAgent", "disk_used_percent", ROOT, 2, 70),
            point("EC2", "i-1", "CWAgent", "disk_used_percent", DATA, 2, 5),
            point("EC2", "i-1", "AWS/EC2", "Unlisted", ID, 2, 1),
        ],
        DATAPOINTS,
    )
    instances = spark.createDataFrame([("i-1", "web", "running"), ("i-2", "db", "stopped")], "resource_id string, name string, state string")
    disks = spark.createDataFrame([(DATA, 0), (ROOT, 1)], "dims array<struct<name:string,value:string>>, ord long")
    raw = spark.createDataFrame([("a", "CWAgent", "disk_used_percent", "GreaterThanThreshold", 60.0, [d for d in reversed(ROOT)], "OK", "", 1)], RAW_ALARM)
    index = thresholds.alarm_index(thresholds.parse_alarms(raw))
    got = {r["resource_id"]: r for r in snapshots.instance_snapshots(instances, data, disks, index, metrics.metric_catalog(spark), NOW).collect()}
    web, db = got["i-1"], got["i-2"]
    assert (web["CPU"], web["NetworkIn"], web["StatusCheck"], web["Disk"], web["Memory"]) == (45.0, 11.0, "FAILED", "70.0", None)
    assert [p["value"] for p in web["MetricTrends"]["CPU"]["H"]] == [10.0, 45.0]
    assert web["MetricTrends"]["Disk"]["TH"]["V"] == 60.0 and len(web["MetricTrends"]["Disk"]["H"]) == 1
    assert set(web["MetricTrends"]) == {"CPU", "NetworkIn", "StatusCheck", "Disk"}
    assert (db["CPU"], db["StatusCheck"], db["Disk"], db["MetricTrends"]) == (None, "UNKNOWN", "CWAgent Not Installed", None)


def test_group_snapshots(spark):
    lb = "Load Balancer"
    dims = [("LoadBalancer", "app/web/1")]
    data = spark.createDataFrame(
        [
            point(lb, "web", "AWS/ApplicationELB", "RequestCount", dims, 30, 7),
            point(lb, "web", "AWS/ApplicationELB", "ProcessedBytes", dims, 30, 100),
            point(lb, "web", "AWS/ApplicationELB", "HTTPCode_ELB_5XX_Count", dims, 5, 2),
        ],
        DATAPOINTS,
    )
    index = thresholds.alarm_index(thresholds.parse_alarms(spark.createDataFrame([], RAW_ALARM)))
    resources = spark.createDataFrame([("web",), ("idle",)], "resource_id string")
    columns = {"request_count": "RequestCount", "processed_bytes": "ProcessedBytes", "elb_5xx": "HTTPCode_ELB_5XX_Count"}
    got = {r["resource_id"]: r for r in snapshots.group_snapshots(resources, lb, data, index, metrics.metric_catalog(spark), NOW, columns).collect()}
    # Bytes were last seen half an hour ago, outside the short window that untracked metrics use.
    assert (got["web"]["request_count"], got["web"]["processed_bytes"], got["web"]["elb_5xx"]) == (7.0, 0.0, 2.0)
    assert list(got["web"]["MetricTrends"]) == ["RequestCount"]
    assert (got["idle"]["request_count"], got["idle"]["MetricTrends"]) == (0.0, None)
