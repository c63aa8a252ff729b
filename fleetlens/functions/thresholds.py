"""Fixed values of the rule model: thresholds, horizons and sizing goals."""

WINDOW_DAYS = 14

# idle
IDLE_CPU_P95_PCT = 3.0
IDLE_NET_MBPS = 2.0
IDLE_DISK_IOPS = 5.0
STRONG_IDLE_PEAK_PCT = 1.0
STRONG_IDLE_NET_KBPS = 1.0

# cpu
RUN_QUEUE_PER_CORE_LINUX = 1.0
RUN_QUEUE_PER_CORE_WINDOWS = 2.0
CPU_UNDER_PCT = 70.0
CPU_TARGET_PCT = 70.0
CPU_QUEUE_HEADROOM = 0.7
CPU_CORE_HOLD_PCT = 85.0
CPU_STEAL_BIAS_PCT = 5.0
BLOCKED_HIGH = 1.0

# memory
MEM_UNDER_PCT = 90.0
MEM_TARGET_PCT = 80.0
MEM_HEADROOM_PCT = 30.0
WINDOWS_PAGES_IN_PER_S = 20.0

# disk capacity
RUNWAY_DAYS = 30.0
TARGET_RUNWAY_DAYS = 365.0
TREND_SPAN_DAYS = 14.0
RATE_SPAN_DAYS = 30.0 / 24.0
NEAR_HORIZON_DAYS = 30.0
HEADROOM_PCT = 70.0
STATIC_GUARD_PCT = 85.0

# disk io
DISK_QUEUE_WINDOWS = 2.0
AWAIT_MS = 20.0
DISK_BUSY_MIN = 0.5

# network
RETRANS_PCT = 1.0
DROP_PCT = 0.5
MIN_TRAFFIC_KBPS = 10.0
CONNTRACK_RATIO = 0.8

# confidence and trend
CONFIDENCE_HOURS = 30.0
MIN_SUFFICIENCY = 0.7
BURST_RATIO = 2.0
RISING_PCT_PER_DAY = 0.2
BURST_PEAK_CPU_PCT = 30.0
BURST_PEAK_MEM_PCT = 50.0
VARIANCE_RATIO = 1.5
FREQUENT_RESTARTS = 3

# liveness
ONLINE_SECONDS = 300
FUTURE_SKEW_SECONDS = 120
BOOT_TOLERANCE_SECONDS = 5
