"""Service classification: unit name, process name and port to a workload category, as column expressions.

Services and sockets of a host sit in one inventory row, so everything here works inside the row with higher-order
functions; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category -> name keywords, in matching order (the first keyword contained in a name wins).
KEYWORDS = {
    "web": ["nginx", "httpd", "apache", "caddy", "lighttpd", "traefik", "haproxy", "w3svc", "iis", "openresty", "tomcat",
            "jetty", "php-fpm", "gunicorn", "uwsgi"],
    "db": ["postgresql", "postgres", "mariadb", "mysqld", "mysql", "mongod", "mongodb", "cassandra", "influxdb", "sqlservr",
           "mssql", "oracle", "elasticsearch", "opensearch", "clickhouse", "db2"],
    "cache": ["redis", "memcached", "varnish", "valkey", "keydb", "dragonfly"],
    "mq": ["rabbitmq", "kafka", "activemq", "nats", "mosquitto", "pulsar", "redpanda", "emqx", "artemis"],
    "container": ["docker", "containerd", "kubelet", "podman", "crio", "k3s", "k0s"],
    "monitor": ["prometheus", "grafana", "datadog", "node_exporter", "zabbix", "telegraf", "collectd", "fluentd",
                "fluent-bit", "filebeat", "victoriametrics", "loki", "netdata", "alertmanager"],
    "remote": ["sshd", "ssh", "openssh", "rdp", "termservice", "umrdpservice", "winrm", "wsmprovhost", "tigervnc", "x11vnc",
               "vino", "vncserver", "teamviewer", "anydesk", "telnetd"],
    "file": ["nfsd", "nfs", "rpc.mountd", "rpcbind", "smbd", "samba", "nmbd", "vsftpd", "proftpd", "pure-ftpd", "glusterd",
             "ceph-osd", "minio", "iscsid", "tgtd"],
    "mail": ["postfix", "sendmail", "exim", "exim4", "dovecot", "cyrus", "opendkim", "rspamd", "amavis", "zimbra"],
    "infra": ["named", "dnsmasq", "unbound", "pdns", "coredns", "knot", "dhcpd", "dhcp", "kea", "chronyd", "ntpd", "slapd",
              "sssd", "winbind", "squid", "privoxy", "snmpd", "keepalived"],
}
# Category -> service name -> well-known ports.
PORTS = {
    "web": {"nginx": [80, 443], "apache2": [80, 443], "httpd": [80, 443], "caddy": [80, 443], "lighttpd": [80, 443],
            "haproxy": [80, 443], "traefik": [80, 443, 8080], "tomcat": [8080]},
    "db": {"postgresql": [5432], "postgres": [5432], "mysqld": [3306], "mysql": [3306], "mariadb": [3306],
           "mongod": [27017], "cassandra": [9042, 9160], "influxdb": [8086], "oracle": [1521], "sqlservr": [1433],
           "mssql": [1433], "elasticsearch": [9200, 9300], "opensearch": [9200, 9300], "clickhouse": [8123, 9000],
           "db2": [50000]},
    "cache": {"redis-server": [6379], "redis": [6379], "memcached": [11211], "varnish": [6081, 6082], "valkey": [6379],
              "keydb": [6379], "dragonfly": [6379]},
    "mq": {"rabbitmq-server": [5672, 15672], "rabbitmq": [5672, 15672], "kafka": [9092], "nats-server": [4222, 8222],
           "activemq": [61616, 8161], "mosquitto": [1883, 8883], "pulsar": [6650], "emqx": [1883]},
    "container": {},
    "monitor": {"prometheus": [9090], "node_exporter": [9100], "zabbix": [10050, 10051], "alertmanager": [9093],
                "victoriametrics": [8428], "loki": [3100], "netdata": [19999]},
    "remote": {"sshd": [22], "rdp": [3389], "termservice": [3389], "winrm": [5985, 5986], "vncserver": [5900, 5901],
               "tigervnc": [5900, 5901], "telnetd": [23]},
    "file": {"nfsd": [2049], "rpc.mountd": [20048], "rpcbind": [111], "smbd": [445, 139], "samba": [445, 139],
             "vsftpd": [21], "proftpd": [21], "pure-ftpd": [21], "minio": [9001], "iscsid": [3260], "tgtd": [3260]},
    "mail": {"postfix": [25, 587, 465], "sendmail": [25], "exim": [25], "exim4": [25], "dovecot": [143, 993, 110, 995],
             "cyrus": [143, 993]},
    "infra": {"named": [53], "dnsmasq": [53], "unbound": [53], "coredns": [53], "dhcpd": [67], "ntpd": [123],
              "chronyd": [123], "slapd": [389, 636], "squid": [3128], "snmpd": [161, 162]},
}
# Services and ports found on nearly every host.
BASELINE_KEYWORDS = ["sshd", "ssh", "openssh", "rdp", "termservice", "umrdpservice", "winrm", "wsmprovhost", "tigervnc",
                     "x11vnc", "vino", "vncserver", "telnetd", "chronyd", "ntpd", "ntpdate", "timesyncd", "resolved",
                     "rpcbind", "gssproxy", "sssd", "winbind", "systemd-"]
BASELINE_PORTS = [22, 23, 3389, 5985, 5986, 5900, 5901, 123, 111]
SIGNATURE = ["web", "db", "cache", "mq", "container", "monitor"]
SINGLE_INSTANCE = ["container"]
DYNAMIC_PORT_MIN = 49152

CATEGORIES = list(KEYWORDS)


def keyword_pairs() -> list[tuple[str, str]]:
    return [(k, cat) for cat, words in KEYWORDS.items() for k in words]


def port_categories() -> dict[int, str]:
    """Port -> category; the earlier category keeps a shared port."""
    out: dict[int, str] = {}
    for cat, names in PORTS.items():
        for ports in names.values():
            for p in ports:
                out.setdefault(p, cat)
    return out


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def keyword_sql(name: str) -> str:
    """First catalog keyword contained in the (lower-case) name; the catalog is one constant array."""
    words, cats = zip(*keyword_pairs())
    return (f"get(transform(filter(arrays_zip({_array(words)}, {_array(cats)}), k -> contains({name}, k.`0`)), "
            "k -> k.`1`), 0)")


def port_sql(port: str) -> str:
    pc = port_categories()
    return f"try_element_at(map_from_arrays({_array(pc)}, {_array(pc.values())}), {port})"


def well_known_sql(name: str, port: str) -> str:
    """Is ``port`` a well-known port of the service called ``name``?"""
    pairs = [f"{n}:{p}" for names in PORTS.values() for n, ps in names.items() for p in ps]
    return f"array_contains({_array(pairs)}, concat({name}, ':', {port}))"


def baseline_sql(name: str) -> str:
    return f"exists({_array(BASELINE_KEYWORDS)}, k -> contains(lower(coalesce({name}, '')), k))"


def baseline_socket_sql(p: str) -> str:
    return f"({baseline_sql(p + '.comm')} or {p}.port in ({', '.join(map(str, BASELINE_PORTS))}))"


def match_keyword(name: str) -> Column:
    """Column form of ``keyword_sql`` for a column holding lower-case names."""
    return F.expr(keyword_sql(name))


# sockets in (port, proto) order with their own category signals
_SOCKETS = (
    "transform(array_sort(transform(coalesce(listen_ports, array()), (p, i) -> named_struct('port', p.port, 'proto', "
    "coalesce(p.proto, ''), 'pos', i, 'pid', p.pid, 'comm', lower(coalesce(p.comm, ''))))), p -> named_struct("
    "'port', p.port, 'proto', p.proto, 'pid', p.pid, 'comm', p.comm, 'base', {base}, 'kcat', {kcat}, 'pcat', {pcat}))"
).format(base=baseline_socket_sql("p"), kcat=keyword_sql("p.comm"), pcat=port_sql("p.port"))


def _unique(arr: str) -> str:
    """Drop repeated (proto, port) from an array in (port, proto) order."""
    return (f"filter({arr}, (x, i) -> i = 0 or not (x.port = element_at({arr}, i).port and x.proto = element_at({arr}, i).proto))")


def _first(arr: str, field: str) -> str:
    return f"get(filter(transform({arr}, a -> a.{field}), k -> k is not null), 0)"


def with_sockets(inventory: DataFrame) -> DataFrame:
    """Inventory with ``sockets``: the listen ports in order, each with baseline flag and category signals."""
    return inventory.withColumn("sockets", F.expr(_SOCKETS))


def service_items(inventory: DataFrame) -> DataFrame:
    """One row per service: category, attributed ports and matched ports.

    A service with a pid owns the sockets of that pid. Without one it is matched by process name or well-known port.
    """
    s = with_sockets(inventory.select("server_id", "services", "listen_ports")).selectExpr(
        "server_id", "sockets", "posexplode(services) as (pos, s)").selectExpr(
        "server_id", "sockets", "pos", "s.unit as unit", "s.sub as sub", "s.pid as pid",
        "regexp_replace(lower(s.unit), '[.]service$', '') as name")
    s = s.withColumn("display_name", F.expr("regexp_replace(unit, '[.]service$', '')"))
    s = s.withColumns({
        "by_pid": F.expr("filter(sockets, p -> p.pid = pid)"),
        "by_name": F.expr("filter(sockets, p -> (p.comm <> '' and p.comm <> 'systemd' and (contains(p.comm, name) or "
                          f"contains(name, p.comm))) or {well_known_sql('name', 'p.port')})"),
        "name_cat": F.expr(keyword_sql("name"))})
    s = s.withColumns({"by_pid": F.expr(_unique("by_pid")), "by_name": F.expr(_unique("by_name"))})
    s = s.withColumn("attributed", F.expr("if(pid is not null, by_pid, by_name)"))
    s = s.withColumns({
        "category": F.expr(f"coalesce(name_cat, {_first('attributed', 'kcat')}, {_first('attributed', 'pcat')}, 'unknown')"),
        "category_by_name": F.expr(f"coalesce(name_cat, {_first('by_name', 'kcat')}, {_first('by_name', 'pcat')}, 'unknown')")})
    s = s.withColumn("matched", F.expr(
        "filter(sockets, p -> if(p.pid is not null, coalesce(p.pid = pid, false), category_by_name <> 'unknown' and "
        "coalesce(p.pcat = category_by_name, false)))"))
    return s.withColumns({"matched": F.expr(_unique("matched")), "baseline": F.expr(baseline_sql("unit"))}).select(
        "server_id", "pos", "unit", "sub", "pid", "display_name", "category", "baseline", "attributed", "matched")


def listen_items(inventory: DataFrame, skip_baseline: bool = False) -> DataFrame:
    """One row per listening (proto, port) that shows a category by process name or by port."""
    s = with_sockets(inventory.select("server_id", "listen_ports")).selectExpr("server_id", "explode(sockets) as p")
    if skip_baseline:
        s = s.filter("not p.base")
    s = s.selectExpr("server_id", "p.proto as proto", "p.port as port", "coalesce(p.kcat, p.pcat) as category")
    return s.filter("category is not null").dropDuplicates(["server_id", "proto", "port"])


def workload_counts(inventory: DataFrame) -> DataFrame:
    """Per host and category: how many services show it. A container stack counts once, a category that only sockets
    show counts one."""
    named = (service_items(inventory).filter("not baseline and category <> 'unknown'").groupBy("server_id", "category")
             .agg(F.count("*").alias("named")))
    heard = listen_items(inventory, skip_baseline=True).select("server_id", "category").distinct()
    both = named.join(heard.withColumn("heard", F.lit(True)), ["server_id", "category"], "full_outer")
    single = F.col("category").isin(SINGLE_INSTANCE)
    n = F.when(F.col("named").isNull() | single, F.lit(1).cast("bigint")).otherwise(F.col("named"))
    return both.select("server_id", "category", n.alias("instances"), F.col("named").isNull().alias("listen_only"))


def infer_role(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """Most frequent category per host (ties by name), ``unknown`` without any."""
    best = counts.groupBy("server_id").agg(F.min(F.struct((-F.col("instances")).alias("n"), "category")).alias("b"))
    return hosts.select("server_id").join(best, "server_id", "left").select(
        "server_id", F.coalesce("b.category", F.lit("unknown")).alias("role"))


def service_categories(inventory: DataFrame) -> DataFrame:
    """Sorted categories per host, from names and sockets, without baseline services."""
    c = workload_counts(inventory).groupBy("server_id").agg(F.sort_array(F.collect_set("category")).alias("c"))
    return inventory.select("server_id").join(c, "server_id", "left").select(
        "server_id", F.coalesce("c", F.array().cast("array<string>")).alias("categories"))


def service_catalog(inventory: DataFrame) -> DataFrame:
    """Signature categories (all of them, also with zero hosts) with their services: (category, total_hosts, service,
    hosts). A container stack is one entry named after its parts; hosts only sockets reveal are counted without a name."""
    spark = inventory.sparkSession
    sig = F.col("category").isin(SIGNATURE)
    counts = workload_counts(inventory).filter(sig)
    total = counts.groupBy("category").agg(F.count("*").alias("total_hosts"))
    named = service_items(inventory).filter(~F.col("baseline") & sig).select(
        "server_id", "category", F.col("display_name").alias("service")).distinct()
    single = F.col("category").isin(SINGLE_INSTANCE)
    multi = named.filter(~single).groupBy("category", "service").agg(F.count("*").alias("hosts"))
    names = named.filter(single).select("category", "service").distinct().groupBy("category").agg(
        F.array_join(F.sort_array(F.collect_list("service")), ", ").alias("service"))
    stacks = named.filter(single).select("server_id", "category").distinct().groupBy("category").agg(F.count("*").alias("hosts"))
    one = names.join(stacks, "category").select("category", "service", "hosts")
    only = listen_only_hosts(inventory).filter(sig).groupBy("category").agg(F.count("*").alias("hosts"))
    rows = multi.unionByName(one).unionByName(only.select("category", F.lit("(port)").alias("service"), "hosts"))
    frame = spark.createDataFrame([(c,) for c in SIGNATURE], "category string")
    return frame.join(total, "category", "left").fillna(0, ["total_hosts"]).join(rows, "category", "left")


def listen_only_hosts(inventory: DataFrame) -> DataFrame:
    """(category, host) pairs shown by sockets minus those with a named service."""
    counts = workload_counts(inventory)
    return counts.select("server_id", "category").join(
        counts.filter("not listen_only").select("server_id", "category"), ["server_id", "category"], "left_anti")


def service_rollup(inventory: DataFrame) -> DataFrame:
    """Per host and category: its ports, and the representative unit (the first with ports, else the first).

    A (proto, port) is shown once per host: by the category whose first unit comes first, and by categories only
    sockets reveal after those.
    """
    items = service_items(inventory).filter("category <> 'unknown'")
    units = items.groupBy("server_id", "category").agg(
        F.min(F.struct((F.size("matched") == 0).alias("silent"), "pos", "display_name")).alias("rep"),
        F.min("pos").cast("bigint").alias("rank"))
    heard = listen_items(inventory)
    only = heard.groupBy("server_id", "category").agg((F.min("port") + 1000000).cast("bigint").alias("late"))
    ranks = units.select("server_id", "category", "rank", "rep").join(only, ["server_id", "category"], "full_outer").select(
        "server_id", "category", F.coalesce("rank", "late").alias("rank"), F.col("rep.display_name").alias("unit"))
    ports = items.selectExpr("server_id", "category", "explode(matched) as p").selectExpr(
        "server_id", "category", "p.proto as proto", "p.port as port")
    ports = ports.unionByName(heard.select("server_id", "category", "proto", "port")).distinct()
    ports = ports.join(ranks.drop("unit"), ["server_id", "category"]).groupBy("server_id", "proto", "port").agg(
        F.min_by("category", F.struct("rank", "category")).alias("category"))
    lists = ports.groupBy("server_id", "category").agg(F.sort_array(F.collect_list(F.struct("port", "proto"))).alias("ports"))
    return ranks.drop("rank").join(lists, ["server_id", "category"], "left")


def significant_ports(inventory: DataFrame) -> DataFrame:
    """Listening ports below the dynamic range that no service or category claims."""
    sockets = inventory.selectExpr("server_id", "explode(listen_ports) as p").selectExpr(
        "server_id", "p.proto as proto", "p.port as port", "p.comm as comm").filter(F.col("port") < DYNAMIC_PORT_MIN)
    claimed = service_rollup(inventory).selectExpr("server_id", "explode(ports) as p").selectExpr("server_id", "p.port as port")
    return sockets.join(claimed.distinct(), ["server_id", "port"], "left_anti")
