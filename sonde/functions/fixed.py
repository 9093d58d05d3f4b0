"""Fixed values.

Word lists, lookup tables, weights, patterns and formats that results depend on.
They are stated as plain text; nothing here is logic.
"""

# ---------------------------------------------------------------- column aliases
TIME_COLUMNS = ("timestamp", "startTime", "time", "datetime")
COMPONENT_COLUMNS = ("cmdb_id", "tc", "serviceName", "service")
KPI_COLUMNS = ("kpi_name", "name")
TRACE_ID_COLUMNS = ("traceId", "trace_id")
SPAN_ID_COLUMNS = ("id", "span_id")
PARENT_ID_COLUMNS = ("pid", "parent_id", "parent_span")
DURATION_COLUMNS = ("elapsedTime", "duration")
NEVER_A_KPI = (
    "timestamp", "startTime", "time", "datetime", "itemid", "bomc_id", "index",
    "traceId", "trace_id", "span_id", "parent_id", "pid", "id",
)
FAILED_WORDS = ("false", "0", "fail", "failed")

# ---------------------------------------------------------------- time
MILLISECOND_FLOOR = 10_000_000_000
LOCAL_OFFSET_SECONDS = 8 * 3600
HALF_HOUR = 1800
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# ---------------------------------------------------------------- tasks
FIELD_TIME = "root cause occurrence datetime"
FIELD_COMPONENT = "root cause component"
FIELD_REASON = "root cause reason"
TASK_FIELDS = {
    "task_1": (FIELD_TIME,),
    "task_2": (FIELD_REASON,),
    "task_3": (FIELD_COMPONENT,),
    "task_4": (FIELD_TIME, FIELD_REASON),
    "task_5": (FIELD_TIME, FIELD_COMPONENT),
    "task_6": (FIELD_COMPONENT, FIELD_REASON),
    "task_7": (FIELD_TIME, FIELD_COMPONENT, FIELD_REASON),
}
CRITERION_COMPONENT = "The {idx} predicted root cause component is {component}"
CRITERION_REASON = "The {idx} predicted root cause reason is {reason}"
CRITERION_TIME = (
    "The {idx} root cause occurrence time is within 1 minutes (i.e., <=1min) of {datetime}"
)
COMPONENT_CRITERION_RE = r"The (?:\d+-th|only) predicted root cause component is ([^\n]+)"
REASON_CRITERION_RE = r"The (?:\d+-th|only) predicted root cause reason is ([^\n]+)"
TIME_CRITERION_RE = (
    r"The (?:\d+-th|only) root cause occurrence time is within 1 minutes "
    r"\(i\.e\., <=1min\) of ([^\n]+)"
)
PREDICTION_RE = (
    r'\{\s*(?:"root cause occurrence datetime":\s*"(.*?)")?,?\s*'
    r'(?:"root cause component":\s*"(.*?)")?,?\s*'
    r'(?:"root cause reason":\s*"(.*?)")?\s*\}'
)
FAILURE_COUNT_PATTERNS = (
    r"number of failures(?: recorded)?(?: within this time range)? is (\d+)",
    r"number of failures:\s*(\d+)",
    r"(\d+)\s+failures?\s+(?:were?|are|was|is|detected|reported|observed)",
    r"(\d+)\s+failures?\b",
)
FAILURE_COUNT_WORDS = (("two", 2), ("three", 3), ("four", 4), ("five", 5))
DIFFICULTY = {
    "task_1": "easy", "task_2": "easy", "task_3": "easy",
    "task_4": "middle", "task_5": "middle", "task_6": "middle", "task_7": "hard",
}

# ---------------------------------------------------------------- KPI vocabulary
LOW_SENSITIVE_WORDS = ("success", "succee", "sr", "rr", "rate", "avail", "idle")
PERCENT_WORDS = ("percent", "pct", "perc", "util", "rate")
PERCENT_WORDS_NARROW = ("percent", "perc", "pct", "util")
FREE_WORDS = ("free", "idle", "avail")
MEMORY_WORDS = ("mem", "memory", "heap")
BUSY_DISK_WORDS = ("dskpercentbusy", "diskpercentbusy")

KPI_CATEGORIES = (
    ("memory", ("memused", "mem_used", "heap", "oom", "swap", "memoryused", "memory_used",
                "jvm.*memory")),
    ("memory", ("memfree", "mem_free", "cache")),
    ("cpu", ("cpu", "proc", "load", "throttl")),
    ("network", ("network", "tcp", "net", "packet", "retrans", "timeout", "latency", "delay",
                 "connection")),
    ("disk", ("disk", "dsk", "i/o", "io_", "iowait", "space", "read", "write")),
    ("db", ("jdbc", "sql", "database", "db_", "mysql", "redis", "mongo", "connect", "pool")),
    ("process", ("restart", "terminated", "killed", "crash", "exit", "kill", "process")),
)
CPU_EXCLUSIONS = ("idle", "free")

# rule number, key words, reasons in order of preference
REASON_HINT_RULES = (
    (("oom", "heap"),
     ("JVM Out of Memory (OOM) Heap", "high memory usage", "container memory load")),
    (("jvmfreememory", "jvmmaxmemory", "jvmtotalmemory", "jvmusedmemory", "jvm_memory",
      "heapmemory", "noheapmemory"),
     ("high memory usage", "container memory load")),
    (("jvm", "cpuload"),
     ("high JVM CPU load", "high CPU usage", "CPU fault", "container CPU load")),
    (("cpu", "proc_user", "cpu_used", "cpucpu", "cpuutil"),
     ("high CPU usage", "CPU fault", "container CPU load", "node CPU load")),
    (("mem", "memory"),
     ("high memory usage", "container memory load", "node memory consumption")),
    (("packet", "loss"),
     ("network packet loss", "network loss", "container packet loss")),
    (("fin-wait", "close-wait", "time-wait"),
     ("network packet loss", "network latency", "network delay")),
    (("latency", "delay", "mrt", "avg_time", "elapsed", "slow", "timeout"),
     ("network latency", "network delay", "container network latency")),
    (("connect", "sess", "client"), ("db connection limit",)),
    (("close",), ("db close",)),
    (("disk", "i/o", "io_", "iowait", "read"),
     ("high disk I/O read usage", "node disk read I/O consumption")),
    (("write",), ("node disk write I/O consumption", "container write I/O load")),
    (("space", "used"), ("high disk space usage", "node disk space consumption")),
    (("restart", "terminated", "kill"), ("container process termination",)),
    (("corrupt",), ("container network packet corruption",)),
    (("iowait",), ("high disk I/O read usage", "CPU fault")),
)
REASON_HINT_RULES_SHORT = (
    (("oom", "heap"), ("JVM Out of Memory (OOM) Heap", "high memory usage")),
    (("jvm", "cpuload"), ("high JVM CPU load", "high CPU usage", "CPU fault")),
    (("cpu", "proc_user"), ("high CPU usage", "CPU fault")),
    (("mem", "memory"), ("high memory usage",)),
    (("packet", "loss", "fin-wait", "close-wait"),
     ("network packet loss", "network loss", "db close")),
    (("latency", "delay", "mrt", "time", "avg_time", "tnsping"),
     ("network latency", "network delay")),
    (("connect", "sess"), ("db connection limit",)),
    (("disk", "i/o", "io_", "iowait", "read"),
     ("high disk I/O read usage", "high disk space usage")),
    (("space", "used"), ("high disk space usage", "high memory usage")),
)

# ---------------------------------------------------------------- components
TYPE_PRIORS = {
    ("db", "db"): 0.40, ("db", "redis"): 0.40, ("db", "service"): 0.55,
    ("db", "pod"): 0.55, ("db", "node"): 0.45,
    ("redis", "db"): 0.40, ("redis", "redis"): 0.40, ("redis", "service"): 0.55,
    ("redis", "pod"): 0.55, ("redis", "node"): 0.45,
    ("service", "db"): 0.50, ("service", "redis"): 0.50, ("service", "service"): 0.55,
    ("service", "pod"): 0.55, ("service", "node"): 0.45,
    ("pod", "db"): 0.50, ("pod", "redis"): 0.50, ("pod", "service"): 0.55,
    ("pod", "pod"): 0.55, ("pod", "node"): 0.45,
    ("node", "db"): 0.60, ("node", "redis"): 0.60, ("node", "service"): 0.60,
    ("node", "pod"): 0.65, ("node", "node"): 0.50,
}
TYPE_PRIOR_DEFAULT = 0.45
COMPONENT_SUFFIXES = ("-grpc", ".ts:8088", ".ts:8080", ".source", ".destination")

# component type, reason words, prior; the first row that applies wins
REASON_PRIORS = (
    (("db", "redis"), ("db", "connection", "close", "limit"), 0.85),
    (("db", "redis"), ("memory", "oom", "heap", "mem"), 0.80),
    (("node",), ("node", "cpu", "network", "delay", "loss", "disk"), 0.85),
    (("pod",), ("container", "jvm", "memory", "cpu", "packet", "network"), 0.75),
    (("service",), ("latency", "timeout", "delay"), 0.90),
    (("service",), ("network", "packet", "loss"), 0.85),
    (("service",), ("cpu", "jvm", "load"), 0.60),
    (("service",), ("memory", "oom", "heap"), 0.55),
    (("service",), ("db", "connection"), 0.70),
    (("middleware",), ("latency", "timeout", "delay"), 0.80),
    (("middleware",), ("network", "packet", "loss"), 0.80),
    (("middleware",), ("cpu", "jvm", "load"), 0.60),
    (("middleware",), ("memory", "oom", "heap"), 0.55),
)
REASON_PRIOR_DEFAULT = 0.35

# ---------------------------------------------------------------- logs
TEMPLATE_RE = r"0x[0-9a-fA-F]+|[a-fA-F0-9]{16,}|\d+\.\d+|\d+"
TEMPLATE_MARK = "<*>"
LOG_ERROR_WORDS = (
    "error", "exception", "fail", "timeout", "refused", "overflow", "out of memory",
    "deadlock", "crash", "connection reset", "broken pipe", "high memory", "cpu", "gc", "oom",
)
# key words, reasons in order of preference (empty: any candidate), weight
LOG_REASON_RULES = (
    (("outofmemory", "oom", "heap"), ("JVM Out of Memory (OOM) Heap", "high memory usage"), 3.0),
    (("gc", "cms", "memory"), ("high memory usage", "JVM Out of Memory (OOM) Heap"), 1.0),
    (("cpu",), ("high CPU usage", "CPU fault", "high JVM CPU load"), 1.5),
    (("timeout", "latency", "delay", "slow"), ("network latency", "network delay"), 2.0),
    (("packet", "loss", "reset"), ("network packet loss", "network loss"), 2.0),
    (("connection", "connect", "too many"), ("db connection limit", "db close"), 2.0),
    (("disk", "i/o", "io ", "read", "write"),
     ("high disk I/O read usage", "high disk space usage"), 1.5),
    (("error", "exception", "fail", "warn"), (), 0.5),
)
TEMPLATE_ERROR_WORDS = ("error", "exception", "fail", "oom", "timeout", "warn")
TEMPLATE_RESOURCE_WORDS = ("gc", "memory", "connect", "packet", "disk")
LOG_FAMILY_WORDS = {
    "cpu": ("cpu", "load average", "processor", "throttl", "load", "busy", "fault"),
    "memory": ("memory", "mem", "oom", "outofmemory", "heap", "swap", "gc overhead", "fullgc",
               "concurrent mode failure"),
    "network": ("network", "timeout", "latency", "delay", "packet", "loss", "retransmit",
                "retrans", "connection refused", "refused", "slow", "elapsed", "reset",
                "unreachable", "timed out"),
    "disk": ("disk", "i/o", "io_", "iowait", "filesystem", "throughput", "space", "read",
             "write"),
    "db": ("jdbc", "sql", "database", "db", "connection", "close", "limit", "pool", "connect",
           "too many connections", "max_connections"),
    "process": ("restart", "terminated", "killed", "crash", "segfault", "exit", "kill"),
}
GC_WORDS = ("gc", "cms", "young generation", "minor collection")
LOG_LEVEL_WORDS = ("error", "fatal", "exception")

# ---------------------------------------------------------------- anomaly scoring
EPS = 1e-8
MAD_TO_SIGMA = 1.4826
IQR_TO_SIGMA = 1.349
TRADITIONAL_WEIGHTS = {"threshold": 0.20, "zscore": 0.35, "rate": 0.25, "deviation": 0.20}
SPECTRAL_WEIGHTS = {"energy": 0.40, "low": 0.20, "high": 0.20, "periodic": 0.10, "entropy": 0.10}
FINAL_WEIGHTS = {"traditional": 0.6, "spectral": 0.4}
ENERGY_Z_CUT = 3.0
RATIO_Z_CUT = 2.5
HIGH_CONFIDENCE = 0.85
CANDIDATE = 0.70
MIN_SPECTRAL_POINTS = 8
MISSING_SHARE = 0.30
SPECTRAL_CLASSES = {
    "none": "no_strong_spectral_anomaly",
    "slow": "slow_trend_anomaly",
    "burst": "fast_burst_or_jitter_anomaly",
    "periodic": "periodic_oscillation_anomaly",
    "mixed": "mixed_spectral_anomaly",
}
REASON_BY_SPECTRAL_CLASS = {
    "slow_trend_anomaly": "resource_exhaustion",
    "fast_burst_or_jitter_anomaly": "sudden_spike_or_instability",
    "periodic_oscillation_anomaly": "periodic_interference_or_misconfiguration",
    "mixed_spectral_anomaly": "complex_failure",
    "no_strong_spectral_anomaly": "unknown",
}
EDGE_WEIGHTS = {"shape": 0.45, "freq": 0.20, "phase": 0.20}
EDGE_KEEP = 0.30
ROOT_WEIGHTS = {"anomaly": 0.40, "out": 0.35, "in": 0.20, "onset": 0.05}
BELIEF_BASE = {
    "validated": 0.9, "spectral_confirmed": 0.7, "evidence_supported": 0.5,
    "hypothesized": 0.2, "evidence_contradicted": 0.1, "spectral_rejected": 0.05,
    "rejected": 0.0,
}

# ---------------------------------------------------------------- source layouts
# layout -> metric file -> (time column, component column, kpi column or wide KPI columns)
METRIC_LAYOUTS = {
    "bank": {
        "metric_app": ("timestamp", "tc", ("rr", "sr", "cnt", "mrt")),
        "metric_container": ("timestamp", "cmdb_id", "kpi_name"),
    },
    "telecom": {
        "metric_app": ("startTime", "serviceName", ("avg_time", "num", "succee_num", "succee_rate")),
        "metric_container": ("timestamp", "cmdb_id", "name"),
        "metric_middleware": ("timestamp", "cmdb_id", "name"),
        "metric_node": ("timestamp", "cmdb_id", "name"),
        "metric_service": ("timestamp", "cmdb_id", "name"),
    },
    "market": {
        "metric_container": ("timestamp", "cmdb_id", "kpi_name"),
        "metric_mesh": ("timestamp", "cmdb_id", "kpi_name"),
        "metric_node": ("timestamp", "cmdb_id", "kpi_name"),
        "metric_runtime": ("timestamp", "cmdb_id", "kpi_name"),
        "metric_service": ("timestamp", "service", ("rr", "sr", "mrt", "count")),
    },
}

# ---------------------------------------------------------------- evidence families
SIGNAL_FAMILIES = (
    # family, word groups that must each be hit
    ("jvm_oom", (("oom", "outofmemory"),)),
    ("jvm_cpu", (("jvm", "heap", "gc", "fullgc"), ("cpu", "load"))),
    ("jvm_memory", (("heap", "jvm"), ("used", "free", "max", "total", "mem", "memory"))),
    ("network_loss", (("packet", "retrans", "corrupt"),)),
    ("network_latency", (("fin-wait", "close-wait", "time-wait"),)),
    ("network_latency", (("latency", "delay", "timeout", "elapsed", "mrt", "response",
                          "avg_time"),)),
    ("network_loss", (("sr", "success"), ("rate", "ratio"))),
    ("disk_space", (("disk", "filesystem", "space", "capacity"),
                    ("space", "used", "free", "capacity", "filesystem"))),
    ("disk_io", (("disk", "i/o", "io_", "iowait", "read", "write", "throughput", "busy"),)),
    ("db_connection", (("mysql", "jdbc", "sql", "innodb", "qcache", "db", "database"),
                       ("connect", "client", "pool", "session", "limit"))),
    ("db_close", (("mysql", "jdbc", "sql", "innodb", "qcache", "db", "database"),
                  ("close", "closed"))),
    ("db", (("mysql", "jdbc", "sql", "innodb", "qcache", "db", "database"),)),
    ("cpu", (("cpu", "processor", "load", "singlecpu", "cpuload"),)),
    ("memory", (("mem", "memory", "rss", "swap", "cachemem", "usermem"),)),
    ("process", (("restart", "terminated", "killed", "kill", "crash", "exit"),)),
)
REASON_FAMILIES = (
    ("jvm_oom", (("oom",),)),
    ("jvm_oom", (("heap",), ("memory",))),
    ("jvm_cpu", (("jvm",), ("cpu",))),
    ("network_loss", (("packet", "loss", "corrupt"),)),
    ("network_latency", (("latency", "delay", "timeout"),)),
    ("disk_space", (("disk",), ("space", "capacity"))),
    ("disk_io", (("disk", "i/o", "io"),)),
    ("db_connection", (("connection", "limit"),)),
    ("db_close", (("db close",),)),
    ("memory", (("memory", "mem"),)),
    ("cpu", (("cpu", "load"),)),
    ("process", (("process", "termination"),)),
)
CLOSE_WORD_RE = r"\bclose\b"
BROAD_FAMILY = {
    "jvm_oom": "memory", "jvm_memory": "memory", "memory": "memory",
    "jvm_cpu": "cpu", "cpu": "cpu",
    "network_loss": "network_loss", "network_latency": "network_latency",
    "disk_space": "disk", "disk_io": "disk",
    "db_connection": "db", "db_close": "db", "db": "db",
}
# component types, signal words, weight; the first row that applies wins
OWNERSHIP_RULES = (
    (("db",), ("mysql", "sql", "innodb", "qcache", "database"), 1.0),
    (("redis",), ("redis",), 1.0),
    (("service", "middleware"), ("tomcat", "apache", "jvm", "heap", "gc"), 1.0),
    (("service", "middleware"),
     ("latency", "delay", "timeout", "packet", "loss", "network", "fin-wait", "close-wait",
      "time-wait", "mrt", "response", "elapsed"), 0.95),
    (("pod", "node"), ("container", "docker", "k8s", "process", "oslinux"), 0.85),
    ((), ("oslinux", "localdisk", "singlecpu", "cpuidle", "cpuwio", "network", "memory_"), 0.45),
)
OWNERSHIP_DEFAULT = 0.65

# ---------------------------------------------------------------- metric type priors
METRIC_TYPES = (
    ("cpu", ("cpu", "cpuload", "proc_user")),
    ("memory", ("mem", "memory", "heap", "oom")),
    ("packet", ("packet", "loss", "fin-wait", "close-wait")),
    ("latency", ("latency", "delay", "mrt", "time", "tnsping", "avg_time")),
    ("connection", ("connect", "sess")),
    ("disk", ("disk", "io", "iowait", "read", "write")),
)
METRIC_TYPE_PRIORS = (
    ("cpu", "high CPU usage", 0.9), ("cpu", "CPU fault", 0.9), ("cpu", "high JVM CPU load", 0.9),
    ("memory", "high memory usage", 0.9), ("memory", "JVM Out of Memory (OOM) Heap", 0.9),
    ("latency", "network latency", 0.8), ("latency", "network delay", 0.8),
    ("packet", "network packet loss", 0.8), ("packet", "network loss", 0.8),
    ("connection", "db connection limit", 0.8), ("connection", "db close", 0.5),
    ("disk", "high disk I/O read usage", 0.8), ("disk", "high disk space usage", 0.8),
)

# ---------------------------------------------------------------- log topology
DATASOURCE_RE = r"Name\s*=\s*([A-Za-z0-9_\-]+?)(?:\s+(?:Property|Ignoring))"
DATASOURCE_NOISE = ("HOST", "USER", "PASSWORD", "URL", "DRIVER")
CACHE_POOL_RE = r"(?i)JedisPool|redis\.clients\.jedis"
JDBC_RE = r"jdbc:(?:mysql|postgresql|oracle)://([^/:\s]+):?(\d+)?"
IP_RE = r"\d+\.\d+\.\d+\.\d+"
CONNECTION_ERROR_RE = (
    r"(?i)Communications link failure|connection.{0,5}timeout|connection.{0,5}refused|"
    r"HikariPool.*timeout|connection.{0,5}closed"
)
ACCESS_RE = r"(?m)^\s*([A-Za-z][A-Za-z0-9_\-]+?)\s+(?:GET|POST|PUT|DELETE|HEAD|PATCH)\s+\S+"
ACCESS_LOG_RE = r"(?i)access_log|localhost_access_log"
ACCESS_NOISE = ("http", "https", "k6", "curl", "wget", "mozilla")
LOG_CALLS = 5

# ---------------------------------------------------------------- reason evidence
# reason words, evidence as (category, share), boosts by component type, other types
CATEGORY_REASONS = (
    (("cpu", "load"), "cpu", {"service": 1.2, "pod": 1.1, "node": 1.0}, 0.8),
    (("memory", "oom", "heap"), "memory", {"redis": 1.3, "pod": 1.2, "service": 1.0}, 0.8),
    (("network", "latency", "delay", "timeout"), "network",
     {"service": 1.2, "pod": 1.1, "middleware": 1.0}, 0.8),
    (("packet", "loss"), (("network", 0.7), ("process", 0.3)), {"service": 1.1, "pod": 1.0}, 0.8),
    (("disk", "i/o", "space"), (("disk", 1.0),), {"node": 1.2, "db": 1.1}, 0.8),
    (("db", "connection", "close", "limit"), (("db", 1.0), ("network", 0.3)),
     {"db": 1.5, "redis": 1.3}, 0.7),
    (("jvm",), (("memory", 0.5), ("cpu", 0.5)), {"service": 1.2, "pod": 1.1}, 0.8),
)
# expected KPI families of a reason
REASON_SIGNATURES = {
    "high memory usage": {"jvm_memory": 1.0, "memory": 0.8, "jvm_oom": 0.9},
    "JVM Out of Memory (OOM) Heap": {"jvm_oom": 1.0, "jvm_memory": 0.9, "memory": 0.6},
    "high CPU usage": {"cpu": 1.0, "jvm_cpu": 0.8},
    "high JVM CPU load": {"jvm_cpu": 1.0, "cpu": 0.7},
    "network packet loss": {"network_loss": 1.0},
    "network latency": {"network_latency": 1.0},
    "network delay": {"network_latency": 1.0},
    "high disk I/O read usage": {"disk_io": 1.0, "cpu": 0.3},
    "high disk space usage": {"disk_space": 1.0, "disk_io": 0.3},
    "db connection limit": {"db_connection": 1.0, "db": 0.5},
    "db close": {"db_close": 1.0, "db": 0.5},
    "container memory load": {"jvm_memory": 0.8, "memory": 1.0},
    "container CPU load": {"cpu": 1.0, "jvm_cpu": 0.6},
    "container network packet loss": {"network_loss": 1.0},
    "container network latency": {"network_latency": 1.0},
    "container process termination": {"process": 1.0},
    "node CPU load": {"cpu": 1.0},
    "node memory consumption": {"memory": 1.0, "jvm_memory": 0.5},
    "CPU fault": {"cpu": 1.0},
}
CONNECTION_STATE_WORDS = (
    "tcp-fin-wait", "tcp-close-wait", "tcp-time-wait", "fin-wait", "close-wait", "time-wait",
)
INTERFACE_WORDS = (
    "netbandwidthutil", "netkbtotalpersec", "netpacketsin", "netpacketsout", "nic", "bandwidth",
    "network_throughput", "network_bytes", "net_", "eth0", "ens",
)
REASON_WEIGHTS = {"kpi": 0.35, "observed": 0.15, "prior": 0.45}
DIRECT_TYPE_PRIOR = {
    "service": 0.85, "pod": 0.80, "node": 0.75, "middleware": 0.75, "redis": 0.70, "db": 0.65,
}
DIRECT_TYPE_PRIOR_DEFAULT = 0.70

# ---------------------------------------------------------------- KPI lists of the fixed sampler
SAMPLED_KPIS = {
    "telecom": (
        "Proc_Used_Pct", "Sess_Connect", "Proc_User_Used_Pct", "On_Off_State",
        "tnsping_result_time", "container_cpu_used", "Memory_used_pct", "Disk_io_util",
        "Sent_queue", "Received_queue",
    ),
    "bank": (
        "JVM-Operating System_7779_JVM_JVM_CPULoad",
        "JVM-Operating System_7778_JVM_JVM_CPULoad",
        "JVM-Memory_7778_JVM_Memory_NoHeapMemoryUsed",
        "JVM-Memory_7779_JVM_Memory_NoHeapMemoryUsed",
        "JVM-Memory_7779_JVM_Memory_HeapMemoryUsage",
        "JVM-Memory_7778_JVM_Memory_HeapMemoryUsage",
        "JVM-Memory_7778_JVM_Memory_HeapMemoryUsed",
        "JVM-Memory_7779_JVM_Memory_HeapMemoryUsed",
        "OSLinux-CPU_CPU_CPUCpuUtil",
        "OSLinux-CPU_CPU-0_SingleCpuUtil",
        "OSLinux-OSLinux_MEMORY_MEMORY_MEMUsedMemPerc",
        "OSLinux-OSLinux_MEMORY_MEMORY_NoCacheMemPerc",
        "OSLinux-OSLinux_MEMORY_MEMORY_MEMFreeMem",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sda_DSKReadWrite",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sdb_DSKRead",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sdb_DSKReadWrite",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sdb_DSKRTps",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sda_DSKRTps",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sda_DSKRead",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sda_DSKBps",
        "OSLinux-OSLinux_LOCALDISK_LOCALDISK-sda_DSKPercentBusy",
        "OSLinux-OSLinux_NETWORK_NETWORK_TCP-FIN-WAIT",
        "OSLinux-OSLinux_NETWORK_ens160_NETBandwidthUtil",
        "OSLinux-OSLinux_NETWORK_NETWORK_TotalTcpConnNum",
        "OSLinux-OSLinux_NETWORK_ens160_NETPacketsOut",
        "OSLinux-OSLinux_NETWORK_ens160_NETPacketsIn",
        "OSLinux-OSLinux_NETWORK_ens160_NETKBTotalPerSec",
        "OSLinux-OSLinux_NETWORK_NETWORK_TCP-CLOSE-WAIT",
    ),
    "market": (
        "container_threads", "container_cpu_usage_seconds", "system.cpu.pct_usage",
        "system.mem.used", "container_memory_usage_MB", "container_fs_reads./dev/vda",
        "container_fs_writes./dev/vda", "system.io.r_s", "system.io.w_s",
        "container_fs_writes./dev/vda1", "system.disk.used", "system.disk.pct_usage",
        "container_network_receive_packets.eth0", "container_network_receive_MB.eth0",
        "recommendationservice-grpc", "frontend-http", "cartservice-grpc",
        "checkoutservice-grpc", "productcatalogservice-grpc", "emailservice-grpc",
        "adservice-grpc",
    ),
}

# ---------------------------------------------------------------- component types (fixed values)
NODE_PREFIXES, NODE_NAMES = ("os_", "node-"), ("host", "node")
DB_WORD, DB_PREFIX, REDIS_WORD = "mysql", "db", "redis"
POD_PREFIX, POD_SUFFIX_RE, POD_MARK = "docker_", r"-\d+$", "."
SERVICE_WORDS = ("tomcat", "apache", "service", "frontend", "cart", "checkout")
MIDDLEWARE_PREFIXES, MIDDLEWARE_WORDS = ("mg", "ig"), ("middleware", "gateway")

# ---------------------------------------------------------------- explanation sentences (fixed values)
EXPLAIN_LEVELS = {
    "high_confidence_anomaly": "shows high-confidence anomaly",
    "candidate_anomaly": "shows candidate anomaly",
    "normal_or_weak": "appears normal or weak",
}
EXPLAIN_SCORES = (  # column, lower bound, words before the number
    ("traditional_score", 0.5, "high traditional score"),
    ("max_abs_z", 3.0, "elevated robust z-score"),
    ("spectral_score", 0.5, "high spectral score"),
)
EXPLAIN_CLASSES = {
    "slow_trend_anomaly": "suggesting slow trend anomaly",
    "fast_burst_or_jitter_anomaly": "suggesting burst/jitter anomaly",
    "periodic_oscillation_anomaly": "suggesting periodic oscillation",
    "mixed_spectral_anomaly": "suggesting mixed spectral anomaly",
}
EXPLAIN_TOO_SHORT = " has insufficient data for anomaly detection."
RANK_ANOMALY = ((0.7, "has high anomaly score"), (0.4, "has moderate anomaly score"))
RANK_ANOMALY_LOW = "has low anomaly score"
RANK_HINTS = (  # column, lower bound, words
    ("out_evidence", 0.5, "strong outgoing propagation"),
    ("in_evidence", 0.3, "significantly affected by others"),
    ("onset_bonus", 0.5, "early onset time"),
)
RANK_SUBJECT, RANK_CLASS = "Node ", "spectral type: "
