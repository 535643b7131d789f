"""Operating systems, their display names and groups."""

GENERAL_PURPOSE = "General-Purpose OS"
NETWORK = "Network OS"

#: Names as they stand in fingerprint tables, their groups and their labels.
NAMES = (
    ("ubuntu", GENERAL_PURPOSE, "Ubuntu"),
    ("debian", GENERAL_PURPOSE, "Debian"),
    ("raspbian", GENERAL_PURPOSE, "Raspbian"),
    ("rhel", GENERAL_PURPOSE, "RHEL"),
    ("centos", GENERAL_PURPOSE, "CentOS"),
    ("fedora", GENERAL_PURPOSE, "Fedora"),
    ("rocky", GENERAL_PURPOSE, "Rocky Linux"),
    ("alma", GENERAL_PURPOSE, "AlmaLinux"),
    ("amazon-linux", GENERAL_PURPOSE, "Amazon Linux"),
    ("oracle-linux", GENERAL_PURPOSE, "Oracle Linux"),
    ("suse", GENERAL_PURPOSE, "SUSE"),
    ("alpine", GENERAL_PURPOSE, "Alpine Linux"),
    ("arch", GENERAL_PURPOSE, "Arch Linux"),
    ("gentoo", GENERAL_PURPOSE, "Gentoo"),
    ("linux", GENERAL_PURPOSE, "Linux"),
    ("freebsd", GENERAL_PURPOSE, "FreeBSD"),
    ("openbsd", GENERAL_PURPOSE, "OpenBSD"),
    ("netbsd", GENERAL_PURPOSE, "NetBSD"),
    ("bsd", GENERAL_PURPOSE, "BSD"),
    ("windows", GENERAL_PURPOSE, "Microsoft Windows"),
    ("macos", GENERAL_PURPOSE, "macOS"),
    ("solaris", GENERAL_PURPOSE, "Solaris"),
    ("aix", GENERAL_PURPOSE, "AIX"),
    ("hpux", GENERAL_PURPOSE, "HP-UX"),
    ("unix", GENERAL_PURPOSE, "Unix"),
    ("vmware-esxi", GENERAL_PURPOSE, "VMware ESXi"),
    ("proxmox-ve", GENERAL_PURPOSE, "Proxmox VE"),
    ("cisco-ios", NETWORK, "Cisco IOS"),
    ("cisco-iosxe", NETWORK, "Cisco IOS XE"),
    ("cisco-iosxr", NETWORK, "Cisco IOS XR"),
    ("cisco-nxos", NETWORK, "Cisco NX-OS"),
    ("cisco-asa", NETWORK, "Cisco ASA"),
    ("cisco-ftd", NETWORK, "Cisco FTD"),
    ("huawei-vrp", NETWORK, "Huawei VRP"),
    ("juniper-junos", NETWORK, "Juniper Junos"),
    ("juniper-junos-evolved", NETWORK, "Juniper Junos Evolved"),
    ("juniper-screenos", NETWORK, "Juniper ScreenOS"),
    ("mikrotik-routeros", NETWORK, "MikroTik RouterOS"),
    ("mikrotik-swos", NETWORK, "MikroTik SwOS"),
    ("fortinet-fortios", NETWORK, "Fortinet FortiOS"),
    ("paloalto-panos", NETWORK, "Palo Alto PAN-OS"),
    ("sonicos", NETWORK, "SonicWall SonicOS"),
    ("zynos", NETWORK, "Zyxel ZyNOS"),
    ("zyxel-zld", NETWORK, "Zyxel ZLD"),
    ("zyxel-uos", NETWORK, "Zyxel uOS"),
    ("drayos", NETWORK, "DrayTek DrayOS"),
    ("watchguard-fireware", NETWORK, "WatchGuard Fireware"),
    ("sophos-sfos", NETWORK, "Sophos Firewall OS"),
    ("fritzos", NETWORK, "AVM FRITZ!OS"),
    ("asuswrt", NETWORK, "ASUSWRT"),
    ("edgeos", NETWORK, "Ubiquiti EdgeOS"),
    ("unifi-os", NETWORK, "Ubiquiti UniFi OS"),
    ("airos", NETWORK, "Ubiquiti airOS"),
    ("arubaos", NETWORK, "ArubaOS"),
    ("arubaos-cx", NETWORK, "ArubaOS-CX"),
    ("nokia-sros", NETWORK, "Nokia SR OS"),
    ("dell-os10", NETWORK, "Dell SmartFabric OS10"),
    ("cumulus-linux", NETWORK, "NVIDIA Cumulus Linux"),
    ("sonic", NETWORK, "SONiC"),
    ("vyos", NETWORK, "VyOS"),
    ("pfsense", NETWORK, "pfSense"),
    ("opnsense", NETWORK, "OPNsense"),
    ("arista-eos", NETWORK, "Arista EOS"),
    ("extreme-exos", NETWORK, "ExtremeXOS"),
    ("hp-comware", NETWORK, "HP Comware"),
    ("f5-bigip", NETWORK, "F5 BIG-IP"),
    ("checkpoint-gaia", NETWORK, "Check Point Gaia"),
    ("zte", NETWORK, "ZTE"),
    ("openwrt", NETWORK, "OpenWrt"),
    ("dd-wrt", NETWORK, "DD-WRT"),
    ("synology", NETWORK, "Synology"),
    ("synology-dsm", NETWORK, "Synology DSM"),
    ("synology-srm", NETWORK, "Synology SRM"),
    ("qnap", NETWORK, "QNAP"),
    ("qnap-qts", NETWORK, "QNAP QTS"),
    ("qnap-quts-hero", NETWORK, "QNAP QuTS hero"),
    ("truenas", NETWORK, "TrueNAS"),
    ("truenas-core", NETWORK, "TrueNAS CORE"),
    ("truenas-scale", NETWORK, "TrueNAS SCALE"),
    ("embedded", NETWORK, "Embedded OS"),
    ("router", NETWORK, "Router OS"),
    ("printer", NETWORK, "Printer OS"),
)


def dimension_rows() -> list[tuple[str, str, str]]:
    """(OS_NAME, OS_GROUP, OS_LABEL)"""
    return [*NAMES]


def dimension(spark):
    return spark.createDataFrame(dimension_rows(), "OS_NAME string, OS_GROUP string, OS_LABEL string")
