"""Table schemas, the metric catalog and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

DISPLAY_TZ = "Asia/Kolkata"

# --- fixed values -----------------------------------------------------------------
# Vocabularies that results must agree on. Kept as plain text in natural order.

TREND_LOOKBACK_MINUTES = 60
SNAPSHOT_LOOKBACK_MINUTES = 10
PERIOD_SECONDS = 300
MAX_ATTEMPTS = 4
FIRST_RETRY_SECONDS = 5
KEEP_ARCHIVES = 5
KEEP_PROMPTS = 5

EC2 = "EC2"
LOAD_BALANCER = "Load Balancer"
SCALING_GROUP = "Auto Scaling Group"

RESOURCE_TYPE_LABELS = {"EC2": "EC2 Instance"}
SKIP_LABELS = {"EC2": "Instance", "Load Balancer": "Load Balancer", "Auto Scaling Group": "Auto Scaling Group"}
COLLECTOR_LABELS = {
    "cloudwatch": "CloudWatch",
    "alb": "ALB",
    "autoscaling": "AutoScaling",
    "cloudtrail": "CloudTrail",
}
RUN_STATUS_LABELS = {
    "SUCCESS": "COMPLETED",
    "PARTIAL_SUCCESS": "COMPLETED_WITH_ERRORS",
    "FAILED": "FAILED",
}
SEVERITY_RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
THRESHOLD_OPERATORS = {
    "GreaterThanThreshold": "GT",
    "GreaterThanOrEqualToThreshold": "GTE",
    "LessThanThreshold": "LT",
    "LessThanOrEqualToThreshold": "LTE",
}
INSTANCE_STATES_ANALYZED = ["running", "stopped", "pending", "stopping"]
LB_STATES_ANALYZED = ["active", "active_impaired"]
NO_DISK_AGENT = "CWAgent Not Installed"
RUN_PHASES = {
    "COLLECTING_METRICS": "Collecting Metrics",
    "BUILDING_CONTEXT": "Building Context",
    "RUNNING_AI_ANALYSIS": "Running AI Analysis",
    "GENERATING_RCA": "Generating RCA",
    "PUBLISHING_DASHBOARD": "Publishing Dashboard",
}
STATUS_KINDS = {
    "completed": "completed",
    "success": "completed",
    "running": "running",
    "in_progress": "running",
    "failed": "failed",
    "error": "failed",
    "healthy": "healthy",
    "warning": "warning",
    "degraded": "warning",
    "critical": "critical",
    "down": "failed",
    "completed_with_errors": "warning",
    "partial_success": "warning",
}
ENTITY_PATTERNS = {
    "EC2 Instance": r"i-[0-9a-f]{8,17}",
    "Security Group": r"sg-[0-9a-f]{8,17}",
    "VPC": r"vpc-[0-9a-f]{8,17}",
    "Subnet": r"subnet-[0-9a-f]{8,17}",
    "Volume": r"vol-[0-9a-f]{8,17}",
    "Network Interface": r"eni-[0-9a-f]{8,17}",
    "Internet Gateway": r"igw-[0-9a-f]{8,17}",
    "NAT Gateway": r"nat-[0-9a-f]{8,17}",
    "Auto Scaling": r"arn:aws:autoscaling:[^\s\"]+",
    "Load Balancer": r"arn:aws:elasticloadbalancing:[^\s\"]+",
    "IAM": r"arn:aws:iam:[^\s\"]+",
}
# resource type, short name, namespace, metric, statistic, unit, tracked as a trend
METRIC_CATALOG = [
    ("EC2", "CPU", "AWS/EC2", "CPUUtilization", "Average", "%", True),
    ("EC2", "Memory", "CWAgent", "mem_used_percent", "Average", "%", True),
    ("EC2", "Disk", "CWAgent", "disk_used_percent", "Average", "%", True),
    ("EC2", "NetworkIn", "AWS/EC2", "NetworkIn", "Sum", "Bytes", True),
    ("EC2", "NetworkOut", "AWS/EC2", "NetworkOut", "Sum", "Bytes", True),
    ("EC2", "StatusCheck", "AWS/EC2", "StatusCheckFailed", "Maximum", "Count", True),
    ("Load Balancer", "RequestCount", "AWS/ApplicationELB", "RequestCount", "Sum", "Count", True),
    ("Load Balancer", "TargetResponseTime", "AWS/ApplicationELB", "TargetResponseTime", "Average", "Seconds", True),
    ("Load Balancer", "HTTPCode_Target_4XX_Count", "AWS/ApplicationELB", "HTTPCode_Target_4XX_Count", "Sum", "Count", True),
    ("Load Balancer", "HTTPCode_Target_5XX_Count", "AWS/ApplicationELB", "HTTPCode_Target_5XX_Count", "Sum", "Count", True),
    ("Load Balancer", "HealthyHostCount", "AWS/ApplicationELB", "HealthyHostCount", "Average", "Count", True),
    ("Load Balancer", "UnHealthyHostCount", "AWS/ApplicationELB", "UnHealthyHostCount", "Average", "Count", True),
    ("Load Balancer", "ProcessedBytes", "AWS/ApplicationELB", "ProcessedBytes", "Sum", "Bytes", False),
    ("Load Balancer", "HTTPCode_ELB_4XX_Count", "AWS/ApplicationELB", "HTTPCode_ELB_4XX_Count", "Sum", "Count", False),
    ("Load Balancer", "HTTPCode_ELB_5XX_Count", "AWS/ApplicationELB", "HTTPCode_ELB_5XX_Count", "Sum", "Count", False),
    ("Auto Scaling Group", "DesiredCapacity", "AWS/AutoScaling", "GroupDesiredCapacity", "Average", "Count", True),
    ("Auto Scaling Group", "InServiceInstances", "AWS/AutoScaling", "GroupInServiceInstances", "Average", "Count", True),
    ("Auto Scaling Group", "PendingInstances", "AWS/AutoScaling", "GroupPendingInstances", "Average", "Count", True),
    ("Auto Scaling Group", "TerminatingInstances", "AWS/AutoScaling", "GroupTerminatingInstances", "Average", "Count", False),
    ("Auto Scaling Group", "TotalInstances", "AWS/AutoScaling", "GroupTotalInstances", "Average", "Count", False),
]
# kept name in a redacted document: name in the trend map
KEPT_INSTANCE_METRICS = {
    "cpu": "CPU",
    "memory": "Memory",
    "disk": "Disk",
    "network_in": "NetworkIn",
    "network_out": "NetworkOut",
    "status_check": "StatusCheck",
}
KEPT_LB_METRICS = {
    "request_count": "RequestCount",
    "target_response_time": "TargetResponseTime",
    "http_4xx": "HTTPCode_Target_4XX_Count",
    "http_5xx": "HTTPCode_Target_5XX_Count",
}
KEPT_ASG_METRICS = {"in_service_instances": "InServiceInstances", "pending_instances": "PendingInstances"}
# column, path in the audit payload, type, default
AUDIT_PAYLOAD_FIELDS = [
    ("service", "$.eventSource", "string", "N/A"),
    ("region", "$.awsRegion", "string", "N/A"),
    ("source_ip", "$.sourceIPAddress", "string", "N/A"),
    ("user_agent", "$.userAgent", "string", "N/A"),
    ("read_only", "$.readOnly", "boolean", False),
    ("error_code", "$.errorCode", "string", ""),
    ("error_message", "$.errorMessage", "string", ""),
]
NOT_REGISTERED = "Not registered"
NOT_SCALED = "Not in Auto Scaling"
# --- end of fixed values ----------------------------------------------------------

CATALOG_SCHEMA = (
    "resource_type string, metric_key string, namespace string, metric string, "
    "statistic string, unit string, tracked boolean"
)

DIMS = "array<struct<name:string,value:string>>"

DATAPOINTS = (
    "resource_id string, resource_type string, namespace string, metric string, "
    f"dims {DIMS}, statistic string, unit string, ts timestamp, value double"
)

# On disk each history item is a two-element [label, value] list of mixed types, which reads as strings.
PAYLOAD_JSON = "struct<U:string,TH:struct<V:double,OP:string>,H:array<array<string>>>"
TRENDS_JSON = f"map<string,{PAYLOAD_JSON}>"

INSTANCE_RESOURCE = (
    "struct<Name:string,InstanceId:string,State:string,PrivateIP:string,PublicIP:string,"
    "CPU:double,Memory:double,Disk:string,NetworkIn:double,NetworkOut:double,StatusCheck:string,"
    f"MetricTrends:{TRENDS_JSON}>"
)
TARGET = "struct<instance_id:string,port:int,health:string,reason:string,description:string>"
TARGET_GROUP = (
    "struct<target_group_name:string,protocol:string,port:int,health_check_path:string,"
    f"healthy_hosts:double,unhealthy_hosts:double,targets:array<{TARGET}>,MetricTrends:{TRENDS_JSON}>"
)
LB_METRICS = (
    "struct<request_count:double,processed_bytes:double,response_time:double,elb_4xx:double,"
    "elb_5xx:double,target_4xx:double,target_5xx:double>"
)
LB_RESOURCE = (
    "struct<alb_name:string,dns_name:string,scheme:string,state:string,vpc_id:string,"
    f"metrics:{LB_METRICS},target_groups:array<{TARGET_GROUP}>,MetricTrends:{TRENDS_JSON}>"
)
ASG_METRICS = "struct<desired_capacity:double,in_service:double,pending:double,terminating:double,total_instances:double>"
ASG_MEMBER = (
    "struct<instance_id:string,lifecycle_state:string,health_status:string,"
    "availability_zone:string,instance_type:string>"
)
ASG_RESOURCE = (
    "struct<asg_name:string,launch_template:map<string,string>,min_size:int,max_size:int,desired_capacity:int,"
    "default_cooldown:int,health_check_type:string,health_check_grace_period:int,"
    f"availability_zones:array<string>,target_groups:array<string>,metrics:{ASG_METRICS},"
    f"instances:array<{ASG_MEMBER}>,"
    "scaling_policies:array<struct<policy_name:string,policy_type:string>>,"
    "scaling_activities:array<struct<status:string,description:string,start_time:string>>,"
    f"MetricTrends:{TRENDS_JSON}>"
)
AUDIT_RESOURCE = (
    "struct<event_time:string,event_name:string,username:string,service:string,region:string,source_ip:string,"
    "user_agent:string,resources:array<struct<type:string,name:string>>,read_only:boolean,"
    "error_code:string,error_message:string>"
)
RAW_AUDIT_EVENT = "EventId string, EventTime string, EventName string, Username string, CloudTrailEvent string"
RAW_ALARM = (
    "AlarmName string, Namespace string, MetricName string, ComparisonOperator string, Threshold double, "
    "Dimensions array<struct<Name:string,Value:string>>, StateValue string, StateReason string, ord bigint"
)

REPORT = (
    "severity string, confidence string, root_cause string, summary string, evidence array<string>, "
    "recommendations array<string>, raw_response string"
)
RUN = (
    "run_id string, status string, start_time string, end_time string, execution_time_seconds double, "
    "instances_discovered bigint, instances_analyzed bigint, resources_skipped bigint, "
    "skipped_resources array<struct<instance_id:string,resource_type:string,state:string,reason:string>>, "
    "reports_generated bigint, successful bigint, failed bigint, retries bigint, "
    "llm struct<provider:string,model:string>, collectors map<string,string>, archive_created boolean"
)
CONTEXT = (
    "instance_id string, resource_type string, generated_by string, collector_count int, context struct<"
    f"cloudwatch:{INSTANCE_RESOURCE},"
    "alb:struct<alb_name:string,target_group:string,health:string,reason:string,description:string,port:int>,"
    "autoscaling:struct<asg_name:string,health_status:string,lifecycle_state:string,availability_zone:string,instance_type:string>,"
    "cloudtrail:array<struct<event_time:string,event_name:string,service:string,username:string,source_ip:string,read_only:boolean,error_code:string>>,"
    "alb_name:string,dns_name:string,scheme:string,state:string,vpc_id:string,"
    f"asg_name:string,min_size:int,max_size:int,desired_capacity:int,health_check_type:string,"
    f"metrics:map<string,double>,target_groups:array<{TARGET_GROUP}>,instances:array<{ASG_MEMBER}>,"
    "scaling_activities:array<struct<status:string,description:string,start_time:string>>,"
    f"MetricTrends:{TRENDS_JSON}>"
)

# Origin members of a stored context document.
GENERATED_BY = "tidewatch"
COLLECTOR_COUNT = 4

FEED_TABLES = {
    "summary": "kpi string, value double, delta double, delta_label string",
    "collectors": "collector string, status string",
    "executions": (
        "run_id string, type string, status string, execution_time bigint, successful bigint, failed bigint, "
        "resources bigint, resources_analyzed bigint, resources_skipped bigint, reports_generated bigint, "
        "start_time string, finished_at string"
    ),
    "reports": (
        "report_id string, run_id string, instance_id string, resource_type string, severity string, summary string, "
        "root_cause string, evidence array<string>, recommendations array<string>, detected_at string, "
        "ai_confidence double, is_new boolean, severity_changed_from string, "
        "telemetry struct<state:string,cpu:double,memory:double,disk:string,network_in:double,network_out:double,status_check:string,"
        "request_count:double,target_response_time:double,http_4xx:double,http_5xx:double,healthy_targets:double,unhealthy_targets:double,"
        "desired_capacity:double,in_service_instances:double,pending_instances:double,standby_instances:int,"
        "scaling_activities:array<struct<status:string,description:string,start_time:string>>>"
    ),
    "resources": "type string, id string, label string",
    "analytics": (
        "section string, at timestamp, run_id string, date string, type string, count bigint, avg_seconds double, "
        "critical bigint, high bigint, medium bigint, low bigint"
    ),
}


def struct_of(ddl: str) -> T.StructType:
    """Parse a DDL string without needing a session."""
    return T.StructType.fromDDL(ddl)
