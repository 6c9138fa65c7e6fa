"""Two logs and where their messages begin and end, in bytes."""

# The shared fixtures, whose positions and hits results must equal.

START = r"(?m)^\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.?(\d{6}([+-]\d\d:\d\d)?)?)]"
LAYOUT = "2006-01-02T15:04:05.000000-07:00"

LOG1 = """
[2024-07-29T00:02:49.231231+00:00] User login successful
src: 127.0.0.1:5000
[2024-07-29T01:07:21.923832+00:00] Connection timed out
[2024-07-29T01:11:38.258712+00:00] File uploaded successfully
{filesize: 1024, filename: "test.txt"}
[2024-07-30T00:12:22.799234+00:00] Database connection established
[2024-07-30T01:16:57.293873+00:00] Error reading configuration
[2024-07-30T02:20:36.908172+00:00] Service restarted
[2024-07-30T03:24:47.245671+00:00] User logged out
[2024-07-30T04:25:27.789664+00:00] Permission denied
[2024-07-30T05:28:56.918273+00:00] Cache cleared
[2024-07-30T06:29:23.685562+00:00] Backup completed
"""

LOG2 = """
[2024-07-31T00:02:49.231231+00:00] New user registration completed
User: john_doe
IP: 192.168.1.100
[2024-07-31T01:07:21.923832+00:00] System maintenance started
Details: Upgrading database to version 2.1.0
[2024-07-31T01:11:38.258712+00:00] Critical error detected
Stack trace: NullPointerException at line 127
Service: AuthService
[2024-07-31T02:15:22.799234+00:00] Batch processing completed
Items processed: 1500
Success rate: 99.9%
[2024-07-31T03:20:57.293873+00:00] Security alert
Multiple failed login attempts detected from IP: 10.0.0.55
[2024-07-31T04:25:36.908172+00:00] Cache invalidation triggered
Affected keys: users:*, sessions:*
[2024-07-31T05:30:47.245671+00:00] Backup process initiated
Target: full system backup
Estimated duration: 30 minutes
"""

ENDS1 = [1, 78, 134, 235, 302, 365, 418, 469, 522, 571, 623]
ENDS2 = [1, 101, 208, 334, 438, 547, 646, 764]
