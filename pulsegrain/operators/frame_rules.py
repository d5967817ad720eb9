"""Rules about frame names: CPU categories, idle and I/O leaves, lock primitives, pool workers.

Apply them to distinct names and join the result back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens by which frames of a managed runtime are told apart, in matching order.
# A category has tokens that a name begins with, contains, or equals.
CATEGORY_TOKENS: list[tuple[str, dict[str, tuple[str, ...]]]] = [
    ("RuntimeGeneratedCode", {"starts": ("[jit] ",)}),
    ("Kernel", {"starts": ("[vdso]",)}),
    ("Unresolved", {"starts": ("<",), "matches": (r"\+0x[^+]*$",)}),
    ("GarbageCollection", {"contains": ("gc_heap::", "GCHeap::", "SVR::t_join", "WKS::t_join", "gc_t_join", "GCToEEInterface", "System.GC.")}),
    ("Allocation", {"contains": ("RhpNew", "RhNew", "AllocateString", "RhpGcAlloc", "GcAllocate", "JIT_New", "JIT_TrialAlloc", "AllocateObject", "Alloc(", "::Alloc"), "equals": ("Alloc",)}),
    ("Jit", {"contains": ("libclrjit", "Compiler::", "emitter::", "PreStubWorker", "DoPrestub", "MethodDesc::JitCompile", "UnsafeJitFunction")}),
    (
        "TlsCrypto",
        {
            "contains": ("libssl", "libcrypto", "System.Security.Cryptography", "System.Net.Security", "SslStream", "Interop+OpenSsl", "Interop+Crypto"),
            "starts": ("SSL_", "EVP_", "ERR_", "CRYPTO_", "OPENSSL_", "ossl_", "RSA_", "EC_", "BN_", "SHA", "AES_", "asn1_", "ASN1_", "X509_"),
        },
    ),
    (
        "Compression",
        {
            "contains": (
                "Compression", "deflate", "inflate", "build_tree", "libz.so", "libzstd", "Brotli", "longest_match", "insert_string", "compress_block",
                "fill_window", "slide_hash", "_tr_flush", "crc32", "adler32", "updatewindow", "send_tree",
            )
        },
    ),
    ("Networking", {"contains": ("System.Net.Sockets", "SocketAsyncEngine", "System.Net.Http", "Kestrel", "SystemNative_", "Microsoft.AspNetCore")}),
    ("Serialization", {"contains": ("System.Text.Json", "Google.Protobuf", "System.Xml", "Serializ", "Deserializ", "MessagePack", "Newtonsoft")}),
    (
        "LockingAndSynchronization",
        {"contains": ("Monitor_", "System.Threading.Monitor", "AwareLock", "pthread_mutex", "pthread_cond", "futex", "System.Threading.Lock", "SpinWait", "CrstBase", "raw_spin", "Interlocked")},
    ),
    (
        "ThreadPoolAndScheduling",
        {"contains": ("ThreadPool", "LowLevelLifoSemaphore", "TimerQueue", "finish_task_switch", "__schedule", "schedule_", "try_to_wake_up", "System.Threading.Tasks")},
    ),
    ("Globalization", {"starts": ("icu_", "ucol_", "unorm", "uloc_", "u_str"), "contains": ("System.Globalization", "GlobalizationNative_")}),
    ("Kernel", {"contains": ("clock_gettime", "gettimeofday")}),
]
#: After the kernel image: names of managed code, by the beginnings of the framework's own.
# Prefixes of framework and runtime names, and the categories that tokens stand for.
FRAMEWORK = ("System.", "Microsoft.", "Internal.", "Interop")
NATIVE_RUNTIME = {
    "contains": (
        "__tls_get_addr", "memmove", "memcpy", "memset", "strlen", "strcmp", "malloc", "__libc_free", "tcache", "_int_malloc", "_int_free", "cfree", "write_event_",
        "COMInterlocked", "pthread_getspecific", "__errno_location", "sched_getcpu", "PublishObject", "PInvoke", "libcoreclr", "CorUnix::", "MethodTable", "MethodDesc",
        "CastHelpers", "WriteBarrier", "InlinedMemmove", "EventPipe", "ep_", "ObjectNative",
    ),
    "starts": ("operator new", "JIT_"),
}
#: Categories in the order in which a view shows them.
CATEGORIES = (
    "GarbageCollection", "Allocation", "Jit", "TlsCrypto", "Compression", "Networking", "Serialization", "LockingAndSynchronization", "ThreadPoolAndScheduling",
    "Kernel", "RuntimeOther", "ManagedFramework", "ApplicationCode", "Globalization", "RuntimeGeneratedCode", "Unresolved", "Uncategorized",
)

# Frames that idle, wait for input or output, hold a lock, or belong to the pool and the runtime.
IDLE_PREFIXES = (
    "System.Threading.WaitHandle.", "System.Threading.Monitor.", "System.Threading.SemaphoreSlim.", "System.Threading.Semaphore.", "System.Threading.ManualResetEventSlim.",
    "System.Threading.ManualResetEvent.", "System.Threading.AutoResetEvent.", "System.Threading.LowLevelLifoSemaphore.", "System.Threading.LowLevelMonitor.",
    "System.Threading.SpinWait.", "System.Threading.SpinLock.",
)
IDLE_NAMES = (
    "System.Threading.Thread.Sleep", "System.Threading.Thread.Join", "System.Threading.Tasks.Task.Wait", "System.Threading.Tasks.Task.InternalWait",
    "Interop+Sys.Read", "Interop+Sys.Write", "Interop+Sys.Poll",
)
IDLE_TOKENS = ("PollGCWorker",)
IO_PREFIXES = ("Interop+Sys.", "System.Net.Sockets.Socket.", "System.Net.Sockets.NetworkStream.", "System.IO.FileStream.", "System.IO.Pipes.", "System.Threading.LowLevelLifoSemaphore.")
IO_NAMES = ("System.IO.Stream.Read", "System.IO.Stream.Write", "System.IO.Stream.ReadAsync", "System.IO.Stream.WriteAsync", "System.IO.FileSystem.ReadFile", "System.IO.FileSystem.WriteFile")
LOCK_PREFIXES = ("System.Threading.Monitor.", "System.Threading.Lock.", "System.Threading.LockHolder.", "System.Threading.SpinLock.", "System.Threading.ObjectHeader.")
WORKER_MARKERS = ("System.Threading.PortableThreadPool", "System.Threading.ThreadPoolWorkQueue", "System.Threading.ThreadPool.", "System.Threading._ThreadPoolWaitCallback", "System.Threading.TimerQueue")
POOL_PARK_PREFIXES = ("System.Threading.LowLevelLifoSemaphore.", "System.Threading.PortableThreadPool+WorkerThread.WorkerThreadStart")
RUNTIME_ENTRY_POINTS = ("System.Threading.PortableThreadPool+GateThread.GateThreadStart", "System.Threading.PortableThreadPool+WaitThread.WaitThreadStart", "System.Threading.TimerQueue.TimerThread")


def any_of(name: Column, starts: tuple[str, ...] = (), contains: tuple[str, ...] = (), equals: tuple[str, ...] = (), matches: tuple[str, ...] = ()) -> Column:
    """Whether a name begins with, contains, equals or matches one of the tokens; null is none."""
    tests = [name.startswith(t) for t in starts] + [name.contains(t) for t in contains] + [name == t for t in equals] + [name.rlike(t) for t in matches]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def cpu_category(name: Column, in_kernel: Column | None = None) -> Column:
    """The first category whose rule holds; in_kernel says that the name's module is the kernel."""
    managed = ~name.contains("::") & (F.instr(name, ".") > 1)
    rules = [(F.coalesce(name, F.lit("")) == "", "Uncategorized"), *((any_of(name, **tokens), label) for label, tokens in CATEGORY_TOKENS)]
    rules += [] if in_kernel is None else [(in_kernel, "Kernel")]
    rules += [(managed & any_of(name, starts=FRAMEWORK), "ManagedFramework"), (managed, "ApplicationCode"), (any_of(name, **NATIVE_RUNTIME), "RuntimeOther")]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit("Uncategorized"))


def is_idle(leaf: Column) -> Column:
    return any_of(leaf, IDLE_PREFIXES, IDLE_TOKENS, IDLE_NAMES)


def is_io(leaf: Column) -> Column:
    return any_of(leaf, IO_PREFIXES, (), IO_NAMES)


def is_lock(frame: Column) -> Column:
    return any_of(frame, LOCK_PREFIXES)


def on_pool_worker(frames: Column) -> Column:
    """Whether any frame of a stack marks a thread of the pool."""
    return F.exists(frames, lambda f: any_of(f, WORKER_MARKERS))


def parked_in_pool(frames: Column) -> Column:
    return F.exists(frames, lambda f: any_of(f, POOL_PARK_PREFIXES))


def of_runtime(frames: Column) -> Column:
    return F.exists(frames, lambda f: any_of(f, RUNTIME_ENTRY_POINTS))


# Where the symbols of a module come from, by its name and path.
NOT_FETCHABLE = ("[vdso]", "[vsyscall]", "[heap]", "[stack]", "memfd:doublemapper", "anon_inode")
RUNTIME_MODULES = ("libcoreclr.so", "libclrjit.so", "libclrgc.so", "libhostfxr.so", "libhostpolicy.so", "libmscordaccore.so", "libmscordbi.so", "libnethost.so", "createdump")
RUNTIME_PATHS = ("/usr/share/dotnet/", "/usr/lib/dotnet/", "/usr/local/share/dotnet/", "/dotnet/shared/", "/dotnet/host/")
DISTRIBUTION_MODULES = (
    "libc.so", "libm.so", "libdl.so", "librt.so", "libpthread.so", "ld-linux", "ld.so", "libstdc++.so", "libgcc_s.so", "libcrypto.so", "libssl.so", "libz.so", "libzstd.so",
    "liblzma.so", "libbrotli", "libicu", "libkrb5", "libgssapi", "libcurl.so", "libnuma.so", "libatomic.so", "libunwind",
)
DISTRIBUTION_PATHS = ("/usr/lib/x86_64-linux-gnu/", "/usr/lib/aarch64-linux-gnu/", "/lib/x86_64-linux-gnu/", "/lib/aarch64-linux-gnu/", "/usr/lib64/", "/usr/lib/")


def symbol_source(path: Column) -> Column:
    """NotFetchable, DotnetRuntime, DistributionLibrary or Unknown, by the first rule that holds."""
    file = F.regexp_extract(path, "([^/]+|.*/)$", 1)
    rules = [
        (F.coalesce(path, F.lit("")) == "", "Unknown"),
        (any_of(path, contains=NOT_FETCHABLE) | file.endswith(".dll"), "NotFetchable"),
        (any_of(file, starts=("vmlinuz",), equals=("vmlinux",)), "DistributionLibrary"),
        (any_of(file, equals=RUNTIME_MODULES) | (file.startswith("libSystem.") & file.endswith(".Native.so")) | any_of(path, contains=RUNTIME_PATHS), "DotnetRuntime"),
        (any_of(file, starts=DISTRIBUTION_MODULES) | any_of(path, contains=DISTRIBUTION_PATHS), "DistributionLibrary"),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit("Unknown"))
