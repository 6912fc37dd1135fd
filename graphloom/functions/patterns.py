"""Patterns by entity type. Matching ignores case and treats letters, digits and blanks by Unicode."""

# They decide what is found.
PATTERNS = {
    "IP": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
        r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
        r"\b(?:IP\s+(?:address)?:?\s*)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
        r"\b(?:connects?\s+to|communicates?\s+with|beacons?\s+to)\s+(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
    ),
    "Domain": (
        r"\b[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,}\b",
        r"\b(?:domain|hostname|FQDN)(?:\s+is|\s*:)\s*([a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,})\b",
        r"\b(?:C2|command.{1,5}control|C&C)(?:\s+server)?\s+(?:at\s+)?([a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,})\b",
        r"\b(?:downloads?\s+from|connects?\s+to|queries|resolves)\s+([a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,})\b",
    ),
    "URL": (
        r"https?://[^\s<>\"']+",
        r"ftp://[^\s<>\"']+",
        r"\b(?:URL|link)(?:\s+is|\s*:)\s*(https?://[^\s<>\"']+)\b",
        r"\b(?:downloads?\s+from|fetches|requests)\s+(https?://[^\s<>\"']+)\b",
    ),
    "File": (
        r"\b[a-zA-Z0-9_\-\.]+\.(?:exe|dll|bat|cmd|scr|vbs|js|jar|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|sys|bin|so|dylib)\b",
        r"\b(?:file|filename|executable|binary)(?:\s+is|\s+name|\s*:)\s*([a-zA-Z0-9_\-\.]+\.(?:exe|dll|bat|cmd|scr|vbs|js|jar|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z))\b",
        r"\b(?:drops?|creates?|writes?|generates?)\s+(?:the\s+)?(?:file\s+)?([a-zA-Z0-9_\-\.]+\.(?:exe|dll|bat|cmd|scr|vbs|js|jar|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z))\b",
        r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*\.(?:exe|dll|bat|cmd|scr|vbs|js|jar|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z)\b",
    ),
    "Email": (
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
        r"\b(?:email|e-mail|sender|from)(?:\s+address|\s+is|\s*:)\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b",
    ),
    "Type": (
        r"\b(?:malware|virus|worm|trojan|ransomware|spyware|adware|rootkit|bootkit|keylogger|stealer|infostealer|banker|cryptominer|miner|rat|backdoor|downloader|dropper|loader|botnet|zombie)\b",
        r"\b(?:phishing|spear.?phishing|whaling|social.engineering|watering.hole|supply.chain.attack|living.off.the.land|fileless|zero.day|apt|advanced.persistent.threat)\b",
        r"\b(?:DDoS|DoS|brute.?force|dictionary.attack|credential.stuffing|password.spraying|replay.attack|MITM|man.in.the.middle)\b",
        r"\b(?:this\s+is\s+a|identified\s+as\s+a|classified\s+as\s+a|type\s+of)\s+(malware|virus|trojan|ransomware|spyware|adware|rootkit|backdoor|phishing|attack)\b",
    ),
    "Device": (
        r"\b(?:router|switch|firewall|gateway|proxy|load.?balancer|server|workstation|laptop|desktop|endpoint|host|machine|computer|device|smartphone|tablet|mobile.device|IoT.device|embedded.system)\b",
        r"\b(?:web.server|database.server|mail.server|DNS.server|domain.controller|file.server|print.server|application.server)\b",
        r"\b(?:Windows.server|Linux.server|Unix.server|Apache.server|Nginx.server|IIS.server)\b",
        r"\b(?:targeting|affects|compromises|infects|targets)\s+(?:the\s+)?([a-zA-Z\s]+(?:server|device|system|machine|endpoint|router|switch|firewall)s?)\b",
    ),
    "Vendor": (
        r"\b(?:Microsoft|Apple|Google|Adobe|Oracle|IBM|Intel|AMD|Nvidia|Cisco|VMware|Amazon|Facebook|Meta|Twitter|LinkedIn|Salesforce|SAP|Symantec|McAfee|Trend.Micro|Kaspersky|Avast|AVG|Bitdefender|ESET|F-Secure|Sophos|CrowdStrike|FireEye|Mandiant|Palo.Alto|Fortinet|Check.Point|Juniper|HP|Dell|Lenovo|ASUS|Acer|Sony|Samsung|LG|Huawei|Xiaomi|OnePlus|Mozilla|Canonical|Red.Hat|SUSE|CentOS|Ubuntu|Debian|Android|iOS|macOS|Chrome|Firefox|Safari|Edge|Internet.Explorer)\b",
        r"\b(?:developed.by|created.by|made.by|from|by)\s+([A-Z][a-zA-Z\s&\.]{2,20}(?:Inc|Corp|Corporation|Ltd|Limited|Technologies|Systems|Software|Solutions|Security)?)\b",
    ),
    "Version": (
        r"\b(?:version|ver|v)\s*[\.\:]?\s*(\d+(?:\.\d+)*(?:[a-zA-Z]\d*)?)\b",
        r"\b([A-Za-z0-9\s]+)\s+(?:version\s+)?(\d+(?:\.\d+)*(?:\.[a-zA-Z]\d*)?)\b",
        r"\b(?:Windows\s+(?:XP|Vista|7|8|8\.1|10|11|Server\s+\d{4}(?:\s+R2)?)|macOS\s+\d+\.\d+|iOS\s+\d+\.\d+|Android\s+\d+\.\d+|Linux\s+kernel\s+\d+\.\d+)\b",
    ),
    "Software": (
        r"\b(?:Microsoft\s+Office|Adobe\s+(?:Reader|Acrobat|Flash|Photoshop|Illustrator)|Java|Oracle|MySQL|PostgreSQL|MongoDB|Redis|Elasticsearch|Apache|Nginx|IIS|Tomcat|WordPress|Drupal|Joomla|Magento|Shopify|Salesforce|SAP|AutoCAD|SolarWinds|TeamViewer|Zoom|Slack|Discord|Skype|Chrome|Firefox|Safari|Edge|Internet\s+Explorer|Visual\s+Studio|IntelliJ|Eclipse|Docker|Kubernetes|VirtualBox|VMware|Hyper-V)\b",
        r"\b(?:uses?|leverages?|exploits?|targets?|affects?)\s+([A-Z][a-zA-Z\s]+(?:software|application|program|tool|suite|platform|service))\b",
        r"\b(?:installed|running|executing|using)\s+([A-Z][a-zA-Z\s]+)\s+(?:software|application|program)\b",
    ),
    "Function": (
        r"\b(?:keylogging|screen.?capture|credential.theft|data.exfiltration|remote.access|backdoor.access|privilege.escalation|lateral.movement|persistence|evasion|defense.evasion|command.and.control|C2|C&C|data.encryption|file.encryption|system.monitoring|network.scanning|vulnerability.scanning|exploit|exploitation|payload.delivery|initial.access|reconnaissance|discovery|collection|impact|destruction|denial.of.service|cryptocurrency.mining|botnet.functionality)\b",
        r"\b(?:capable.of|performs|executes|carries.out|conducts|implements)\s+([a-zA-Z\s\-\.]+(?:logging|capture|theft|exfiltration|access|escalation|movement|persistence|evasion|scanning|mining|encryption))\b",
        r"\b(?:function|functionality|capability|feature|behavior|activity)(?:\s+is|\s+includes|\s*:)\s*([a-zA-Z\s\-\.]+)\b",
    ),
    "Platform": (
        r"\b(?:Windows|Linux|macOS|Mac\s+OS|Android|iOS|Unix|FreeBSD|OpenBSD|NetBSD|CentOS|Ubuntu|Red\s*Hat|RHEL|Debian|Fedora|SUSE|Arch|Mint|Kali|Parrot|BlackArch)\b",
        r"\b(?:AWS|Azure|Google\s+Cloud|GCP|Amazon\s+Web\s+Services|Microsoft\s+Azure|DigitalOcean|Linode|Vultr|Heroku|Cloudflare)\b",
        r"\b(?:x86|x64|x86_64|ARM|ARM64|MIPS|PowerPC|RISC-V)\b",
        r"\b(?:targets?|affects?|runs?.on|compatible.with|supports?)\s+([A-Za-z0-9\s]+(?:Windows|Linux|macOS|Android|iOS|Unix))\b",
    ),
    "Malware": (
        r"\b(?:Stuxnet|Conficker|WannaCry|NotPetya|Emotet|TrickBot|Qbot|IcedID|BazarLoader|Cobalt.Strike|Metasploit|Mimikatz|PowerShell.Empire|BloodHound|SharpHound|Rubeus|Kerberoast|ASREPRoast|Impacket|PsExec|WMIExec|SMBExec|DCSync|Golden.Ticket|Silver.Ticket|Skeleton.Key|DCShadow|NTDS\.dit|SAM|SYSTEM|SECURITY|Chrome\.exe|Firefox\.exe|svchost\.exe|explorer\.exe|winlogon\.exe|csrss\.exe|lsass\.exe|smss\.exe|wininit\.exe|spoolsv\.exe)\b",
        r"\b(?:known.as|identified.as|called|named|refers.to)\s+([A-Z][a-zA-Z0-9\-\.\_]+(?:bot|rat|stealer|miner|locker|crypter|packer|loader|dropper)?)\b",
        r"\b([A-Z][a-zA-Z0-9]{3,15})(?:\s+(?:malware|trojan|virus|ransomware|backdoor|rat))\b",
    ),
    "Vulnerability": (
        r"\bCVE-\d{4}-\d{4,7}\b",
        r"\b(?:buffer.overflow|stack.overflow|heap.overflow|integer.overflow|format.string|use.after.free|double.free|null.pointer.dereference|race.condition|injection|XSS|cross.site.scripting|CSRF|cross.site.request.forgery|SQL.injection|LDAP.injection|command.injection|code.injection|path.traversal|directory.traversal|file.inclusion|remote.file.inclusion|local.file.inclusion|XML.external.entity|XXE|server.side.request.forgery|SSRF|insecure.deserialization|broken.authentication|session.fixation|privilege.escalation|authentication.bypass|authorization.bypass|access.control|broken.access.control|security.misconfiguration|cryptographic.failure|insecure.cryptographic.storage|weak.cryptography|insufficient.logging|missing.security.headers)\b",
        r"\b(?:exploits?|targets?|leverages?)\s+(?:a\s+|an\s+|the\s+)?([a-zA-Z\s\-\.]+(?:vulnerability|flaw|weakness|bug|issue|exploit))\b",
        r"\b(?:zero.day|0.day|unpatched|known.vulnerability|security.flaw|critical.vulnerability|high.severity)\b",
    ),
    "ThreatActor": (
        r"\b(?:APT|Advanced Persistent Threat)\s*\d+\b",
        r"\bAPT-?\d+\b",
        r"\b(?:Lazarus|Fancy Bear|Cozy Bear|APT28|APT29|Carbanak|FIN\d+|Turla|Sandworm|Equation Group|Comment Crew|Deep Panda|Axiom|Elderwood|Dragonfly|Energetic Bear|Sofacy|Pawn Storm|Sednit|Strontium|Wizard Spider|Grim Spider|TA\d+|UNC\d+|Winnti|Charming Kitten|OilRig|MuddyWater|Kimsuky|Konni|DarkHotel|Platinum|Stone Panda|Gothic Panda|Naikon|Lotus Blossom|BRONZE BUTLER|BlackTech|Machete|Volatile Cedar)\b",
        r"\b(?:threat actor|threat group|APT group|hacking group|cyber espionage group|nation-state actor|state-sponsored|hacker group|attack group)\s+(?:known as|called|named|identified as)\s+([A-Z][a-zA-Z0-9\s\-]+)\b",
        r"\b([A-Z][a-zA-Z\s]+)\s+(?:group|actor|team|crew)\s+(?:is responsible|has been|was identified|attributed)\b",
        r"\b(?:attributed to|linked to|associated with|believed to be)\s+(?:the\s+)?([A-Z][a-zA-Z0-9\s\-]+(?:\s+(?:group|actor|APT|team))?)\b",
    ),
    "Other": (
        r"\b[a-fA-F0-9]{32}\b",
        r"\b[a-fA-F0-9]{40}\b",
        r"\b[a-fA-F0-9]{64}\b",
        r"\b[a-fA-F0-9]{128}\b",
        r"HKEY_[A-Z_]+\\[^\\]+(?:\\[^\\]+)*",
        r"\b[a-zA-Z0-9_\-\.]+\.exe\b",
        r"\b(?:port|ports?|listening.on|binds?.to)\s+(\d{1,5})\b",
        r"\b(?:HTTP|HTTPS|FTP|SFTP|SSH|Telnet|SMTP|POP3|IMAP|DNS|DHCP|SNMP|SMB|CIFS|NFS|TCP|UDP|ICMP|SSL|TLS)\b",
        r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*\b",
        r"\/(?:[^\/\s]+\/)*[^\/\s]*\b",
    ),
}
#: What may stand before a value, and the value itself as group 1.
CUES = {
    "IP": (
        r"(?:connects?|communicates?|beacons?|sends?|transmits?|downloads?|uploads?|queries|resolves)\s+(?:to|from|with)\s+",
        r"(?:C2|command.{1,5}control|C&C)(?:\s+server)?\s+(?:at|on|is)\s+",
        r"(?:IP|address|host|server|endpoint)(?:\s+is|\s*:)\s*",
    ),
    "Domain": (
        r"(?:domain|hostname|FQDN|C2|command.{1,5}control)(?:\s+is|\s+server|\s*:)\s*",
        r"(?:connects?|queries|resolves|beacons?)\s+(?:to|with)\s+",
        r"(?:downloads?\s+from|fetches\s+from|requests\s+from)\s+",
    ),
    "File": (
        r"(?:drops?|creates?|writes?|generates?|saves?|stores?)\s+(?:the\s+)?(?:file\s+)?",
        r"(?:file|filename|executable|binary|payload)(?:\s+is|\s+name|\s*:)\s*",
        r"(?:executes?|runs?|launches?)\s+",
    ),
}
CUED_VALUES = {
    "IP": r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})",
    "Domain": r"([a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,})",
    "File": r"([a-zA-Z0-9_\-\.]+\.(?:exe|dll|bat|cmd|scr|vbs|js|jar|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z))",
}
# End of the fixed values.
