"""38 boolean features of process, file, registry and web activity, as a name -> column registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names, extensions and patterns the features are defined by.
LOLBINS = (
    "powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe",
    "bitsadmin.exe", "wmic.exe", "schtasks.exe", "wevtutil.exe", "msbuild.exe", "installutil.exe", "msiexec.exe", "regasm.exe", "regsvcs.exe",
    "msxsl.exe", "ieexec.exe", "presentationhost.exe", "mavinject.exe", "control.exe", "atbroker.exe", "diskshadow.exe", "esentutl.exe",
    "extexport.exe", "extrac32.exe", "forfiles.exe", "ftp.exe", "hh.exe", "ie4uinit.exe", "ilasm.exe", "infdefaultinstall.exe", "jsc.exe",
    "makecab.exe", "microsoft.workflow.compiler.exe", "odbcconf.exe", "pcalua.exe", "pcwrun.exe", "register-cimprovider.exe", "scriptrunner.exe",
    "syncappvpublishingserver.exe", "tttracer.exe", "verclsid.exe", "xwizard.exe", "wsl.exe",
)
OFFENSIVE_TOOLS = (
    "mimikatz.exe", "rubeus.exe", "psexec.exe", "psexesvc.exe", "covenant.exe", "empire.exe", "sharpview.exe", "sharphound.exe", "seatbelt.exe",
    "bloodhound.exe", "kerbrute.exe", "impacket.exe", "cobaltstrike.exe", "beacon.exe", "winpeas.exe", "linpeas.exe", "purplesharp.exe", "sliver.exe",
    "havoc.exe",
)
OFFICE = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "visio.exe", "publisher.exe")
BROWSERS = ("chrome.exe", "msedge.exe", "firefox.exe", "iexplore.exe", "brave.exe", "opera.exe")
SHELLS = ("cmd.exe", "powershell.exe", "pwsh.exe", "bash.exe", "sh.exe")
RANSOM_EXT = (
    ".crypt", ".locked", ".encrypted", ".enc", ".aes", ".pay", ".pays", ".ryk", ".ryuk", ".lock", ".cry", ".crypto", ".wcry", ".wncry", ".wannacry",
    ".cerber", ".zepto", ".odin", ".thor", ".aesir", ".sage", ".globe", ".dharma", ".scl", ".decrypt", ".vault",
)
EXECUTABLE_EXT = (".exe", ".dll", ".scr", ".ps1", ".vbs", ".bat", ".cmd", ".js", ".jse", ".wsf", ".wsh", ".hta", ".com", ".pif", ".cpl", ".msi")
DOCUMENT_EXT = (".docx", ".doc", ".xlsx", ".xls", ".pdf", ".pptx", ".ppt", ".txt", ".rtf", ".odt", ".csv")
COMMAND_PATTERNS = {
    "f_cmd_has_enc": r"(?i)\bpowershell(?:\.exe)?\b[^|]*?\s-e(?:c|n|nc|nco|ncod|ncodedcommand)?\b",
    "f_cmd_has_iex": r"(?i)\b(?:iex|invoke-expression)\b",
    "f_cmd_has_downloadstring": r"(?i)\b(downloadstring|downloadfile|webclient|webrequest|invoke-webrequest|iwr|curl|wget|certutil[^|]+(?:-urlcache|-decode|-encode)|bitsadmin[^|]+(?:transfer|/transfer))\b",
    "f_cmd_has_base64_blob": r"[A-Za-z0-9+/=]{60,}",
    "f_cmd_has_pipe_shell": r"(?i)\|\s*(bash|sh|cmd|powershell|pwsh)\b",
    "f_cmd_has_hidden": r"(?i)\s-w(?:indowstyle)?\s+hidden\b",
    "f_cmd_has_bypass": r"(?i)\s-ex(?:ecutionpolicy)?\s+bypass\b",
    "f_cmd_has_noprofile": r"(?i)\s-n(?:o)?p(?:rofile)?\b",
    "f_cmd_has_url": r"(?i)https?://",
    "f_cmd_has_new_object": r"(?i)\bnew-object\b",
    "f_cmd_has_creddump": r"(?i)(sekurlsa::|lsadump::|dpapi::|kerberos::|crypto::|misc::|lsa\s+secrets|sam\s+dump|hashdump|invoke-mimikatz|getsystem|comsvcs\.dll[^\"']*MiniDump|procdump.*lsass|asktgt|kerberoast|asreproast|getticket)",
    "f_cmd_has_schtask_create": r"(?i)\bschtasks(?:\.exe)?\b[^|]*?\s+/(?:create|change|run)\b",
    "f_cmd_has_injection": r"(?i)(createremotethread|writeprocessmemory|virtualallocex|setwindowshook|reflectivedll|invoke-shellcode|invoke-dllinjection|openprocess\(.*?process_all_access|getprocaddress.*loadlibrary)",
    "f_cmd_has_log_clear": r"(?i)\bwevtutil(?:\.exe)?\b[^|]*?\s+(?:cl|clear-log)\b|clear-eventlog|wmic\s+nteventlog\s+where[^|]*?cleareventlog|fsutil\s+usn\s+deletejournal|format\s+/q\s+\w:",
    "f_cmd_has_recon": r"(?i)\b(whoami\s+(?:/all|/groups|/priv)|net\s+(?:user|group|localgroup|view|session)|nltest\s+/d|systeminfo|tasklist\s+/v|netstat\s+-an|ipconfig\s+/all|route\s+print|arp\s+-a|qwinsta|query\s+user|get-aduser|get-adcomputer|get-adgroup|adfind)",
}
URI_PATTERNS = {
    "f_uri_has_sqli": r"(?i)(union\s+select|updatexml|extractvalue|or\s+1\s*=\s*1|';?\s*--|select.*\bfrom\b|benchmark\(|sleep\()",
    "f_uri_has_xss": r"(?i)(<script|javascript:|on(error|load|click|focus)\s*=)",
    "f_uri_has_traversal": r"(?i)(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/)",
    "f_uri_has_webshell": r"(?i)(\.aspx\?cmd|\.php\?cmd|/cmd\.exe\?|/shell\.jsp|/c99\.php|/r57\.php)",
}
RUN_KEYS = r"\\currentversion\\run\b|\\currentversion\\runonce\b|\\currentversion\\runonceex\b|\\currentversion\\policies\\explorer\\run\b|\\winlogon\\(shell|userinit)\b"
SERVICE_KEYS = r"\\services\\[^\\]+\\imagepath\b"
AUTORUN_PLACES = r"/startup/|/start menu/programs/startup"


def _slashed(path: Column) -> Column:
    return F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))


def _name(path: Column) -> Column:
    """Last part of a path, trailing slashes ignored."""
    return F.substring_index(F.rtrim(_slashed(path), F.lit("/")), "/", -1)


def _ext(path: Column) -> Column:
    return F.regexp_extract(_name(path), r"(\.[^.]*)$", 1)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _build() -> dict[str, Callable[[dict[str, Column]], Column]]:
    one = lambda part, names: lambda c: _flag(_name(c[part]).isin(*names))
    target = lambda rule: lambda c: _flag(rule(_slashed(c["target"])))
    found: dict[str, Callable[[dict[str, Column]], Column]] = {
        "f_image_is_lolbin": one("image", LOLBINS),
        "f_image_is_offensive_tool": one("image", OFFENSIVE_TOOLS),
        "f_image_is_shell": one("image", SHELLS),
        "f_parent_is_office": one("parent_image", OFFICE),
        "f_parent_is_browser": one("parent_image", BROWSERS),
        "f_parent_shell_child_lolbin": lambda c: _flag(_name(c["parent_image"]).isin(*SHELLS) & _name(c["image"]).isin(*LOLBINS)),
        "f_parent_office_child_shell": lambda c: _flag(_name(c["parent_image"]).isin(*OFFICE) & _name(c["image"]).isin(*SHELLS)),
        "f_target_in_temp": target(lambda t: t.rlike("/temp/|/tmp/|appdata/local/temp")),
        "f_target_in_appdata": target(lambda t: t.contains("/appdata/")),
        "f_target_in_system32": target(lambda t: t.rlike("/system32/|/syswow64/")),
        "f_target_in_user_profile": target(lambda t: t.rlike("/users/[^/]+/")),
        "f_target_unc_path": target(lambda t: t.startswith("//")),
        "f_ext_is_ransomware": lambda c: _flag(_ext(c["target"]).isin(*RANSOM_EXT)),
        "f_ext_is_executable": lambda c: _flag(_ext(c["target"]).isin(*EXECUTABLE_EXT)),
        "f_ext_is_document": lambda c: _flag(_ext(c["target"]).isin(*DOCUMENT_EXT)),
        "f_ext_double_suspicious": lambda c: _flag(
            F.regexp_extract(_name(c["target"]), r"(\.[^.]*)\.[^.]*$", 1).isin(*DOCUMENT_EXT) & _ext(c["target"]).isin(*EXECUTABLE_EXT)
        ),
    }
    by_command = {k: (lambda c, p=p: _flag(c["command_line"].rlike(p))) for k, p in COMMAND_PATTERNS.items()}
    late = ("f_cmd_has_creddump", "f_cmd_has_schtask_create", "f_cmd_has_injection", "f_cmd_has_log_clear", "f_cmd_has_recon")
    found |= {k: v for k, v in by_command.items() if k not in late}
    found["f_target_run_key"] = lambda c: _flag(F.lower(c["registry_key"]).rlike(RUN_KEYS))
    found["f_target_services_imagepath"] = lambda c: _flag(F.lower(c["registry_key"]).rlike(SERVICE_KEYS))
    found["f_target_autorun_location"] = target(lambda t: t.rlike(AUTORUN_PLACES))
    found |= {k: (lambda c, p=p: _flag(c["http_uri"].rlike(p))) for k, p in URI_PATTERNS.items()}
    return found | {k: by_command[k] for k in late}


#: Feature name -> function of the named input columns; add entries to extend it.
FEATURES = _build()
INPUTS = ("image", "parent_image", "command_line", "target", "registry_key", "http_uri")


def engineer_features(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with all registered features; inputs come from columns of the same name unless given, and are null if absent."""
    given = {k: columns.get(k, F.col(k) if k in df.columns else F.lit(None).cast("string")) for k in INPUTS}
    return df.withColumns({name: make(given) for name, make in FEATURES.items()})


def count_positives(names: list[str] | None = None) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names or list(FEATURES)])


def relabel_by_count(df: DataFrame, count: Column) -> DataFrame:
    """Label 1 from two features on, 0 without any; rows with exactly one go."""
    return df.withColumn("label", F.when(count >= 2, 1).when(count == 0, 0)).where("label IS NOT NULL")


def feature_row_quality(parsed: Column, cached_fields: Column) -> Column:
    return F.when(parsed | cached_fields.isNotNull(), "full").otherwise("degraded")


def model_columns(columns: list[str], leaky: tuple[str, ...] = ("label", "scenario", "sourcetype", "host", "source", "_time"), low_value: tuple[str, ...] = ("event_id", "subject_id", "object_id")) -> list[str]:
    """The columns a model may see, in order."""
    return [c for c in columns if c not in leaky and c not in low_value]
