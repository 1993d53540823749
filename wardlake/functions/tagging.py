"""ATT&CK technique ids of endpoint events.

Each table states which techniques a condition stands for. Conditions are SQL predicates over the
event's columns, so Catalyst compiles a whole table into one projection with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.text import once

# fixed values: techniques | condition

# n = lower process name, c = lower command line, p = lower executable path, uid, ppid
_SHELL = "n IN ('bash','sh','zsh','ksh','csh','dash','fish','tcsh')"
_PY = "n LIKE 'python%'"
PROCESS = [
    ("T1059 T1059.004", _SHELL),
    ("T1059 T1059.006", _PY),
    ("T1059 T1059.007", "n IN ('node','nodejs','deno')"),
    ("T1059", "n IN ('perl','ruby','irb','php','php7','php8')"),
    ("T1036 T1036.005", "p LIKE '/tmp/%' OR p LIKE '/dev/shm/%'"),
    ("T1053 T1053.003", "n IN ('cron','crond','crontab')"),
    ("T1053 T1053.001", "n IN ('at','atd')"),
    ("T1543 T1543.002", "n IN ('systemctl','systemd')"),
    ("T1489", "n IN ('systemctl','systemd') AND (c LIKE '% stop %' OR c LIKE '% stop')"),
    ("T1562 T1562.001", "n IN ('systemctl','systemd') AND (c LIKE '% disable %' OR c LIKE '% mask %')"),
    ("T1547 T1547.006", "n IN ('insmod','rmmod','modprobe')"),
    ("T1548 T1548.003 T1134", "n = 'sudo'"),
    ("T1548 T1548.001 T1134", "n = 'su'"),
    ("T1082", "n IN ('uname','hostname','hostnamectl','lscpu','lshw','dmidecode','arch','dmesg')"),
    ("T1033", "n IN ('id','whoami','who','w','last','users','logname')"),
    ("T1057", "n IN ('ps','top','htop','pgrep','pidof','pstree','procs')"),
    ("T1083", "n IN ('ls','find','locate','updatedb','fd','dir')"),
    ("T1016", "n IN ('ip','ifconfig','route','arp','iwconfig','iw')"),
    ("T1046", "n IN ('nmap','masscan','arp-scan','nbtscan','unicornscan','zmap')"),
    ("T1016 T1049", "n IN ('netstat','ss','lsof')"),
    ("T1069", "n = 'id' OR n IN ('groups','getent','lid') AND c LIKE '%group%'"),
    ("T1007", "n = 'systemctl' AND (c LIKE '%list%' OR c LIKE '%status%') OR n IN ('service','chkconfig','rc-status')"),
    ("T1518", "n IN ('dpkg','rpm','apt','apt-cache','yum','dnf','pacman','snap','flatpak','zypper')"),
    ("T1135", "n IN ('mount','showmount','smbclient')"),
    ("T1201", "n IN ('chage','pam-auth-update')"),
    ("T1087 T1087.001", "n IN ('getent','finger')"),
    ("T1105 T1071 T1071.001", "n IN ('wget','curl','lwp-request','fetch','aria2c')"),
    ("T1021 T1021.004", "n IN ('ssh','scp','sftp','rsync')"),
    ("T1095 T1104", "n IN ('nc','ncat','netcat','socat','nping')"),
    ("T1003", "n LIKE '%mimikatz%' OR c LIKE '%sekurlsa%' OR c LIKE '%lsadump%' OR n IN ('procdump','pspy')"),
    ("T1040", "n IN ('tcpdump','tshark','wireshark','dumpcap','ngrep','ettercap','dsniff')"),
    ("T1132", "c LIKE '%base64%'"),
    ("T1027", "c LIKE '%base64%' AND (c LIKE '%-d%' OR c LIKE '%decode%')"),
    ("T1222 T1222.002", "n IN ('chmod','chown','chattr','setfacl','umask')"),
    ("T1070 T1070.004", "n = 'shred' OR n = 'rm' AND (c LIKE '% -f%' OR c LIKE '% -r%')"),
    ("T1070 T1070.003", "n = 'history' AND c LIKE '%-c%'"),
    ("T1070 T1070.006", "n = 'touch' AND c LIKE '% -t %'"),
    ("T1074", "n IN ('tar','gzip','bzip2','xz','zip','7z','rar','unrar','zstd')"),
    ("T1119", "n = 'find' AND c LIKE '%-exec%'"),
    ("T1486", "n = 'openssl' AND (c LIKE '% enc %' OR c LIKE '% rsautl %') OR n IN ('gpg','gpg2') AND c LIKE '%--encrypt%'"),
    ("T1562 T1562.001", "n = 'iptables' AND c LIKE '% -f%'"),
    ("T1531", "n IN ('userdel','deluser') OR n = 'passwd' AND c LIKE '% -l %'"),
    ("T1490", "n = 'vgremove' OR n = 'lvremove' AND c LIKE '%snap%'"),
    ("T1219", "n IN ('teamviewer','anydesk','vnc','vncserver','x11vnc','rdesktop','xrdp','rustdesk')"),
    ("T1218", f"({_PY} OR n IN ('perl','ruby')) AND (c LIKE '% -e %' OR c LIKE '% -c %')"),
    ("T1068", f"uid = 0 AND ppid > 1 AND ({_SHELL} OR {_PY} OR n IN ('perl','ruby'))"),
]


def _starts(*prefixes: str) -> str:
    return "(" + " OR ".join(f"left(path, {len(p)}) = '{p}'" for p in prefixes) + ")"


def _ends(*suffixes: str) -> str:
    return "(" + " OR ".join(f"right(path, {len(s)}) = '{s}'" for s in suffixes) + ")"


def _has(*parts: str) -> str:
    return "(" + " OR ".join(f"contains(path, '{p}')" for p in parts) + ")"


# path, action
_WRITE = "action IN ('Create','Modify')"
_DELETE = "action = 'Delete'"
_SHELL_FILES = _ends(".bashrc", ".bash_profile", ".bash_login", ".profile", ".zshrc", ".zprofile", ".zshenv", ".cshrc", ".tcshrc", ".kshrc")
FILE = [
    ("T1003 T1003.008", f"path = '/etc/passwd' OR {_starts('/etc/shadow')}"),
    ("T1136 T1098", f"path = '/etc/passwd' AND {_WRITE}"),
    ("T1098", f"{_starts('/etc/sudoers')} OR path = '/etc/sudo.conf'"),
    ("T1098 T1098.004", _has("/.ssh/authorized_keys")),
    ("T1053 T1053.003", _starts("/etc/cron", "/var/spool/cron", "/etc/anacrontab")),
    ("T1053 T1053.001", _starts("/var/spool/at")),
    ("T1543 T1543.002", f"{_starts('/etc/systemd/', '/usr/lib/systemd/', '/run/systemd/')} AND {_ends('.service', '.timer', '.socket')}"),
    ("T1037 T1037.004", "path IN ('/etc/rc.local','/etc/rc.d/rc.local','/etc/init.d/rc.local')"),
    ("T1037 T1546 T1546.004", f"{_SHELL_FILES} OR {_starts('/etc/profile.d/')}"),
    ("T1105 T1036 T1036.005 T1204", f"{_starts('/tmp/', '/dev/shm/')} AND {_WRITE}"),
    ("T1574", f"{_starts('/usr/bin/', '/usr/sbin/', '/usr/local/bin/', '/bin/', '/sbin/')} AND {_WRITE}"),
    ("T1574 T1574.006", f"{_starts('/etc/ld.so')} OR {_starts('/usr/lib/')} AND {_ends('.so')} AND {_WRITE}"),
    ("T1070 T1070.004", f"{_starts('/var/log/')} AND {_DELETE}"),
    ("T1070 T1070.003", f"{_ends('.bash_history', '.zsh_history')} AND {_DELETE}"),
    ("T1552 T1552.001", _has(".env", ".netrc", ".pgpass", ".htpasswd", "id_rsa", "id_ecdsa", "id_ed25519", "id_dsa", ".pem", "credentials.json", "secrets.yaml", "secrets.yml", ".aws/credentials")),
    ("T1505 T1505.003", f"{_starts('/var/www/', '/srv/www/', '/srv/http/', '/usr/share/nginx/', '/var/lib/tomcat')} AND {_ends('.php', '.phtml', '.phar', '.aspx', '.jsp', '.jspx')} AND {_WRITE}"),
    ("T1485", f"{_DELETE} AND {_starts('/var/log/', '/etc/', '/boot/')}"),
    ("T1490", f"{_DELETE} AND {_starts('/var/backups/', '/backup/', '/mnt/backup/')}"),
    ("T1087 T1087.001", "path = '/etc/passwd'"),
]

# remote_port, state
_UP = "state = 'ESTABLISHED'"
NETWORK = [
    ("T1021 T1021.004", "remote_port = 22"),
    ("T1133", f"remote_port = 22 AND {_UP}"),
    ("T1021", "remote_port = 23"),
    ("T1071 T1071.003", "remote_port IN (25,465,587,6667,6697)"),
    ("T1572", f"remote_port = 53 AND {_UP}"),
    ("T1071 T1071.001", f"remote_port IN (80,8080,443,8443) AND {_UP}"),
    ("T1105", f"remote_port IN (80,8080) AND {_UP}"),
    ("T1021 T1021.002", "remote_port = 445"),
    ("T1021 T1021.001", "remote_port = 3389"),
    ("T1021 T1021.005", "remote_port BETWEEN 5900 AND 5910"),
    ("T1090", "remote_port IN (9050,9150)"),
    ("T1041 T1071 T1095", "remote_port IN (4444,5555,6666,7777,8888,1337,31337)"),
    ("T1571", f"{_UP} AND remote_port > 1024 AND remote_port NOT IN (3389,8080,8443) AND remote_port NOT BETWEEN 5900 AND 5910"),
    ("T1048", "remote_port IN (20,21)"),
    ("T1219", "remote_port IN (5938,5939)"),
]

# auth_method, status, outcome, source_ip
AUTH = [
    ("T1078", "status = 'Success' AND outcome = 'Logon'"),
    ("T1133 T1021 T1021.004", "source_ip IS NOT NULL AND auth_method IN ('password','publickey','unknown')"),
    ("T1110", "status = 'Failure'"),
    ("T1110.001", "status = 'Failure' AND auth_method = 'password'"),
    ("T1548 T1548.003 T1134", "auth_method = 'sudo'"),
    ("T1548 T1548.001 T1134", "auth_method = 'su'"),
    ("T1098", "auth_method IN ('sudo','su') AND status = 'Success'"),
]

# key = lower registry path with forward slashes
REGISTRY = [
    ("T1112", "true"),
    ("T1547 T1547.001", "contains(key, 'currentversion/run') OR contains(key, 'winlogon')"),
    ("T1543 T1543.003", "contains(key, '/services')"),
    ("T1546 T1546.012", "contains(key, 'image file execution options')"),
    ("T1574 T1574.001", "contains(key, 'knowndlls')"),
    ("T1003 T1003.001 T1562 T1562.010", "contains(key, '/control/lsa')"),
]


def tags(table: list[tuple[str, str]]) -> Column:
    """Sorted distinct technique ids of the rows of a table whose condition holds."""
    found = [F.when(F.expr(cond), F.array(*[F.lit(t) for t in ids.split()])) for ids, cond in table]
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))))


def with_process_tags(df):
    cols = {"n": F.lower("name"), "c": F.lower("cmd_line"), "p": F.lower(F.coalesce("exe_path", F.lit("")))}
    return once(df, **cols).withColumn("technique_ids", tags(PROCESS)).drop(*cols)


def with_file_tags(df):
    return df.withColumn("technique_ids", tags(FILE))


def with_network_tags(df):
    return df.withColumn("technique_ids", tags(NETWORK))


def with_auth_tags(df):
    return df.withColumn("technique_ids", tags(AUTH))


def with_registry_tags(df, column: str = "reg_key"):
    return once(df, key=F.lower(F.translate(F.col(column), "\\", "/"))).withColumn("technique_ids", tags(REGISTRY)).drop("key")
