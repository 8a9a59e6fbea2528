"""sparkloom subpackage."""
