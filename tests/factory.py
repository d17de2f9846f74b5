"""Small hand-made snapshots with the edge cases of the sources."""

import json

A, B, C = "i-0aaaaaaaaaaaaaaa1", "i-0bbbbbbbbbbbbbbb2", "i-0ccccccccccccccc3"


def payload(values, threshold=None):
    out = {"U": "%", "H": [[f"10:{5 * i:02d}", v] for i, v in enumerate(values)]}
    if threshold:
        out["TH"] = {"V": threshold, "OP": "GT"}
    return out


def instance(id_, state, trends=None, **more):
    base = {
        "Name": f"name of {id_}", "InstanceId": id_, "State": state, "PrivateIP": "10.0.0.1", "PublicIP": "N/A", "CPU": 1.5,
        "Memory": None, "Disk": "CWAgent Not Installed", "NetworkIn": 1.0, "NetworkOut": 2.0, "StatusCheck": "PASS",
        "MetricTrends": trends or {},
    }
    return {**base, **more}


def target(id_, health="healthy", port=80):
    return {"instance_id": id_, "port": port, "health": health, "reason": "r", "description": "d"}


def load_balancer(name, state, groups):
    metrics = {k: 1.0 for k in ("request_count", "processed_bytes", "response_time", "elb_4xx", "elb_5xx", "target_4xx", "target_5xx")}
    return {
        "alb_name": name, "dns_name": "secret.example", "scheme": "internal", "state": state, "vpc_id": "vpc-0123456789",
        "metrics": metrics, "MetricTrends": {"RequestCount": payload([1, 2])},
        "target_groups": [
            {"target_group_name": g, "protocol": "HTTP", "port": 80, "health_check_path": "/", "healthy_hosts": 1.0, "unhealthy_hosts": 0.0,
             "targets": ts, "MetricTrends": {"HealthyHostCount": payload([1])} if i == 0 else {}}
            for i, (g, ts) in enumerate(groups)
        ],
    }


def scaling_group(name, members):
    return {
        "asg_name": name, "launch_template": {}, "min_size": 1, "max_size": 3, "desired_capacity": 2, "default_cooldown": 300,
        "health_check_type": "EC2", "health_check_grace_period": 0, "availability_zones": ["z"], "target_groups": [],
        "metrics": {"desired_capacity": 2.0, "in_service": 1.0, "pending": 0.0, "terminating": 0.0, "total_instances": 2.0},
        "instances": [
            {"instance_id": i, "lifecycle_state": s, "health_status": "Healthy", "availability_zone": "z", "instance_type": "m5"} for i, s in members
        ],
        "scaling_policies": [], "scaling_activities": [{"status": "Successful", "description": "went up", "start_time": "t"}], "MetricTrends": {},
    }


def event(name, entities, error=""):
    return {
        "event_time": "2024-01-01 10:00:00", "event_name": name, "username": "u", "service": "svc", "region": "r", "source_ip": "1.2.3.4",
        "user_agent": "ua", "resources": [{"type": t, "name": n} for t, n in entities], "read_only": False, "error_code": error, "error_message": "",
    }


def envelopes():
    ec2 = "EC2 Instance"
    return {
        "cloudwatch": [
            instance(A, "stale"),
            instance(A, " Running ", {"CPU": payload([10, 95.5], 80.0), "Disk": payload([1])}),
            instance("", "running"),
        ],
        "alb": [
            load_balancer("shared", "active", [("tg1", [target(A), target("10.1.1.1")]), ("tg2", [target(A, "unhealthy")])]),
            load_balancer("broken", "failed", []),
        ],
        "autoscaling": [scaling_group("shared", [(A, "InService"), (B, " Standby ")])],
        "cloudtrail": [
            event("Start", [(ec2, A), ("Security Group", "sg-0123456789")]),
            event("Start", [(ec2, A)], "Denied"),
            event("Stop", [(ec2, A), (ec2, C)]),
        ],
    }


def write_raw(folder, data=None):
    folder.mkdir(parents=True, exist_ok=True)
    for name, resources in (data or envelopes()).items():
        doc = {"collector": name, "resources": resources}
        if name != "cloudtrail":
            doc["timestamp"] = "2024-01-01T10:00:00+00:00"
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return str(folder)
