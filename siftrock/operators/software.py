"""Types of software by fingerprints: one pass over the files, one aggregate a check, one row a set of files that decides.

Fingerprints are a bounded parameter. Every file is asked the checks that its name allows at once, all texts by one automaton; what is shuffled is a count
and the first path of each check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftrock.operators.findings import confidence
from siftrock.operators.matching import matches

PREVIEW = 65536  # characters of a file that are looked at: the rule's own limit, an option of ``matches``


@dataclass(frozen=True)
class Fingerprint:
    """A type holds if any of ``globs`` is met (if there are some), all of ``holds`` are (glob, texts of which one is in
    such a file), and none of ``unless`` held before it. Each of ``hint_globs`` and ``hints`` that is met adds confidence."""

    name: str
    globs: tuple[str, ...] = ()
    holds: tuple[tuple[str, tuple[str, ...]], ...] = ()
    hint_globs: tuple[str, ...] = ()
    hints: tuple[tuple[str, tuple[str, ...]], ...] = ()
    unless: tuple[str, ...] = ()


# ---- fixed values, in the order in which types are tried

FINGERPRINTS = (
    # web services
    Fingerprint(
        "web_service_python",
        holds=(("**/pyproject.toml", ("fastapi", "flask", "django", "starlette", "sanic", "aiohttp", "bottle")),),
        hints=(("**/*.py", ("@app.route", "@app.get", "@app.post", "Flask(__name__)", "FastAPI(", "urls.py")),),
    ),
    Fingerprint(
        "web_service_node",
        holds=(("**/package.json", ('"express":', '"koa":', '"fastify":', '"hapi":', '"@nestjs/', '"next":', '"hono":', '"elysia":')),),
        hints=(("**/*.ts", ("app.get(", "app.post(", "router.get(", "pages/api/")), ("**/*.js", ("app.get(", "app.post(", "router.get(", "pages/api/"))),
    ),
    Fingerprint(
        "web_service_go",
        holds=(("**/go.mod", ("github.com/gin-gonic/gin", "github.com/labstack/echo", "github.com/go-chi/chi", "github.com/gofiber/fiber", "github.com/gorilla/mux")),),
        hints=(("**/*.go", ("http.HandleFunc", "r.GET(", "Mux.HandleFunc")),),
    ),
    Fingerprint("web_service_rust", holds=(("**/Cargo.toml", ("actix-web", "axum", "rocket", "warp", "hyper", "poem", "salvo")),), hints=(("**/*.rs", ("#[get(", "#[post(", "Router::new(", "HttpServer::new(")),)),
    Fingerprint("web_service_ruby", holds=(("**/Gemfile", ("rails", "sinatra", "hanami", "roda")),), hint_globs=("**/config/routes.rb",)),
    Fingerprint("web_service_php", holds=(("**/composer.json", ("symfony/", "laravel/", "slim/slim")),), hints=(("**/*.php", ("Route::get", "#[Route(", "Symfony\\Component\\Routing")),)),
    Fingerprint(
        "web_service_java_kotlin",
        holds=(
            ("**/pom.xml", ("spring-boot-starter-web", "spring-webflux", "jersey", "vertx-web")),
            ("**/build.gradle", ("spring-boot-starter-web", "spring-webflux")),
            ("**/build.gradle.kts", ("spring-boot-starter-web", "spring-webflux")),
        ),
        hints=(("**/*.java", ("@RestController", "@RequestMapping")), ("**/*.kt", ("@RestController", "@RequestMapping"))),
    ),
    Fingerprint("web_service_dotnet", holds=(("**/*.csproj", ("Microsoft.AspNetCore.",)),), hints=(("**/*.cs", ("WebApplication.CreateBuilder", "MapGet(", "MapPost(")),)),
    # tools for the command line
    Fingerprint(
        "cli_python",
        holds=(("**/pyproject.toml", ("[project.scripts]",)), ("**/setup.py", ("console_scripts",))),
        hints=(("**/*.py", ("argparse", "import click", "import typer")),),
        unless=("web_service_python",),
    ),
    Fingerprint(
        "cli_node",
        holds=(("**/package.json", ('"bin":',)),),
        hints=(("**/*.js", ("require('yargs')", "require('commander')", "@oclif/")), ("**/*.ts", ("from 'yargs'", "from 'commander'", "@oclif/"))),
        unless=("web_service_node",),
    ),
    Fingerprint("cli_rust", holds=(("**/Cargo.toml", ("[[bin]]",)),), hints=(("**/*.rs", ("use clap", "structopt::")),), unless=("web_service_rust",)),
    Fingerprint("cli_go", holds=(("**/main.go", ("package main",)),), hints=(("**/*.go", ("flag.Parse(", "github.com/spf13/cobra", "github.com/urfave/cli")),), unless=("web_service_go",)),
    Fingerprint("cli_csharp", holds=(("**/*.csproj", ("<OutputType>Exe</OutputType>",)),), unless=("web_service_dotnet",)),
    # libraries
    Fingerprint(
        "library_python",
        globs=("**/pyproject.toml",),
        hints=(("**/__init__.py", ("__all__",)),),
        unless=("web_service_python", "cli_python", "ml_training", "data_pipeline_airflow", "data_pipeline_dbt", "data_pipeline_prefect", "data_pipeline_dagster"),
    ),
    Fingerprint("library_node", holds=(("**/package.json", ('"main":', '"exports":')),), unless=("web_service_node", "cli_node")),
    Fingerprint("library_rust", holds=(("**/Cargo.toml", ("[lib]",)),), unless=("web_service_rust", "cli_rust", "crypto_library")),
    Fingerprint(
        "library_c",
        globs=("**/CMakeLists.txt", "**/Makefile"),
        hints=(("**/*.c", ("re:^\\s*void\\s+\\w+\\s*\\(", "re:^\\s*int\\s+\\w+\\s*\\(")),),
        unless=(
            "firmware_arduino", "firmware_platformio", "firmware_zephyr", "firmware_espidf", "firmware_stm32", "firmware_baremetal",
            "linux_kernel_module", "linux_kernel_tree", "windows_kernel_driver", "bsd_kernel", "macos_kernel_ext", "os_baremetal",
        ),
    ),
    # mobile, and what shares its files
    Fingerprint("mobile_android", globs=("**/AndroidManifest.xml",), hints=(("**/build.gradle", ("applicationId",)), ("**/build.gradle.kts", ("applicationId",)))),
    Fingerprint(
        "mobile_ios",
        globs=("**/*.xcodeproj", "**/*.xcworkspace", "**/Info.plist"),
        hints=(("**/*.swift", ("@main", "UIApplicationDelegate", "@UIApplicationMain")), ("**/*.m", ("UIApplicationMain",))),
    ),
    Fingerprint(
        "desktop_flutter",
        holds=(("**/pubspec.yaml", ("flutter:",)), ("**/pubspec.yaml", ("flutter_acrylic", "window_manager", "desktop_window", "windows:", "linux:", "macos:"))),
        unless=("mobile_flutter",),
    ),
    Fingerprint("mobile_flutter", holds=(("**/pubspec.yaml", ("flutter:",)),), unless=("desktop_flutter",)),
    Fingerprint("mobile_reactnative", holds=(("**/package.json", ('"react-native":',)),), hint_globs=("**/app.json",)),
    Fingerprint("mobile_kotlin_multiplatform", holds=(("**/build.gradle.kts", ("kotlin-multiplatform",)),)),
    # firmware
    Fingerprint("firmware_arduino", globs=("**/*.ino",), hints=(("**/*.ino", ("void setup(", "void loop(", "pinMode(")),)),
    Fingerprint("firmware_platformio", globs=("**/platformio.ini",)),
    Fingerprint("firmware_zephyr", globs=("**/west.yml", "**/prj.conf"), hints=(("**/*.c", ("SYS_INIT(", "K_THREAD_DEFINE(", "K_WORK_DEFINE(")),)),
    Fingerprint(
        "firmware_espidf",
        globs=("**/sdkconfig", "**/idf_component.yml"),
        hints=(("**/main.c", ("app_main(", "esp_event_handler")), ("**/main.cpp", ("app_main(", "esp_event_handler"))),
    ),
    Fingerprint("firmware_stm32", globs=("**/STM32*.ld", "**/system_stm32*.c"), hints=(("**/*.c", ("HAL_", "NVIC_", "__HAL_RCC_")), ("**/*.h", ("stm32",)))),
    Fingerprint("firmware_nordic_sdk", holds=(("**/*.h", ("nrf_", "NRF_SDK", "nrfx_")),), unless=("firmware_zephyr",)),
    Fingerprint(
        "firmware_baremetal",
        globs=("**/startup_*.s", "**/startup.S", "**/boot.S"),
        holds=(("**/*.ld", ("MEMORY", ".text", ".bss")),),
        hints=(("**/*.c", ("_start", "Reset_Handler", "void __attribute__((interrupt))")), ("**/*.s", ("_start:", "Reset_Handler:"))),
        unless=("firmware_arduino", "firmware_platformio", "firmware_zephyr", "firmware_espidf", "firmware_stm32", "linux_kernel_module", "linux_kernel_tree"),
    ),
    # real-time systems
    Fingerprint("rtos_freertos", globs=("**/FreeRTOSConfig.h",), hints=(("**/*.c", ("xTaskCreate(", "vTaskStartScheduler(", "xQueueCreate(")),)),
    Fingerprint("rtos_zephyr", holds=(("**/prj.conf", ("CONFIG_KERNEL", "CONFIG_THREAD")),)),
    Fingerprint("rtos_threadx", holds=(("**/*.h", ("tx_api.h", "tx_user.h")), ("**/*.c", ("tx_thread_create(", "tx_kernel_enter(")))),
    Fingerprint("rtos_chibios", globs=("**/chconf.h", "**/halconf.h"), hints=(("**/*.c", ("chThdCreateStatic(", "chSysInit(")),)),
    # kernels
    Fingerprint(
        "linux_kernel_module",
        holds=(("**/Kbuild", ("obj-m",)), ("**/Makefile", ("obj-m :=", "obj-m +="))),
        hints=(("**/*.c", ("MODULE_LICENSE", "module_init", "module_exit", "EXPORT_SYMBOL", "<linux/module.h>")),),
    ),
    Fingerprint(
        "linux_kernel_tree",
        globs=("MAINTAINERS",),
        holds=(("Kconfig", ("source", "config", "menuconfig")),),
        hint_globs=("arch/x86/**", "arch/arm/**", "arch/arm64/**", "kernel/**", "Documentation/**"),
    ),
    Fingerprint("windows_kernel_driver", globs=("**/*.inf", "**/*.inx"), hints=(("**/*.c", ("DriverEntry", "WdfDriverEntry", "IO_STACK_LOCATION")),)),
    Fingerprint("bsd_kernel", globs=("**/sys/kern/**/*.c", "**/sys/dev/**/*.c"), hints=(("**/*.c", ("MOD_LOAD", "DEVMETHOD", "DECLARE_MODULE")),)),
    Fingerprint("macos_kernel_ext", globs=("**/*.kext/**/Info.plist",), hints=(("**/*.cpp", ("IOService", "OSDeclareDefaultStructors")),)),
    Fingerprint(
        "os_baremetal",
        globs=("**/linker.ld", "**/app.ld"),
        hints=(("**/*.c", ("_start", "kernel_main", "void __attribute__((noreturn))")),),
        unless=("firmware_arduino", "firmware_platformio", "firmware_zephyr", "firmware_espidf", "firmware_stm32", "firmware_baremetal", "linux_kernel_module", "linux_kernel_tree"),
    ),
    # hardware
    Fingerprint("fpga_verilog", globs=("**/*.v", "**/*.sv"), hint_globs=("**/*.xdc", "**/*.lpf", "**/*.sdc"), hints=(("**/*.v", ("module ", "endmodule")), ("**/*.sv", ("module ", "endmodule")))),
    Fingerprint("fpga_vhdl", globs=("**/*.vhd", "**/*.vhdl"), hint_globs=("**/*.xdc", "**/*.lpf", "**/*.sdc"), hints=(("**/*.vhd", ("entity ", " is", "architecture ")),)),
    Fingerprint("asic_design", globs=("**/*.sdc",), hint_globs=("**/*.def", "**/*.lef")),
    Fingerprint("driver_linux_userspace", holds=(("**/*.c", ("libusb_", "hid_", "spidev_", "ioctl(")),), hint_globs=("**/udev/rules.d/**",), unless=("linux_kernel_module", "linux_kernel_tree")),
    # extensions of browsers
    Fingerprint("browser_ext_chrome", holds=(("**/manifest.json", ('"manifest_version": 3', "background", "content_scripts")),), hints=(("**/*.js", ("chrome.runtime", "chrome.tabs", "chrome.storage")),)),
    Fingerprint("browser_ext_firefox", holds=(("**/manifest.json", ("browser_specific_settings", "gecko")),), hints=(("**/*.js", ("browser.runtime", "browser.tabs")),)),
    Fingerprint("browser_ext_safari", globs=("**/*.safariextz",)),
    # games
    Fingerprint("game_unity", globs=("**/ProjectSettings/*.asset", "**/Assets/**/*.cs"), hints=(("**/*.cs", ("MonoBehaviour", "UnityEngine")),)),
    Fingerprint("game_unreal", globs=("**/*.uproject",), hints=(("**/*.h", ("AActor", "UCLASS(", "GENERATED_BODY")),)),
    Fingerprint("game_godot", globs=("**/project.godot", "**/*.tscn", "**/*.gd")),
    Fingerprint(
        "game_engine",
        holds=(("**/*.cpp", ("class Renderer", "SceneGraph", "ShaderCompiler")), ("**/*.h", ("class Renderer", "SceneGraph", "ShaderCompiler"))),
        unless=("game_unity", "game_unreal", "game_godot"),
    ),
    Fingerprint(
        "compiler_parser",
        globs=("**/*.lex", "**/*.y", "**/*.tree-sitter", "**/*.pest", "**/*.g4"),
        hints=(
            ("**/*.py", ("re:def\\s+parse_\\w+", "re:def\\s+tokenize_\\w+")),
            ("**/*.rs", ("re:fn\\s+parse_\\w+", "re:fn\\s+tokenize_\\w+")),
            ("**/*.c", ("re:\\w+_parse\\s*\\(", "re:\\w+_tokenize\\s*\\(")),
        ),
    ),
    # infrastructure
    Fingerprint("iac_terraform", globs=("**/*.tf",), hint_globs=("**/terraform.tfvars",)),
    Fingerprint("iac_pulumi", globs=("**/Pulumi.yaml",)),
    Fingerprint("iac_helm", globs=("**/Chart.yaml",), hint_globs=("**/templates/**",)),
    Fingerprint("iac_ansible", globs=("**/playbook.yml", "**/playbook.yaml"), hint_globs=("**/roles/**", "**/tasks/**")),
    Fingerprint("iac_cloudformation", holds=(("**/*.template", ("AWSTemplateFormatVersion",)), ("**/*.yaml", ("AWSTemplateFormatVersion",)), ("**/*.yml", ("AWSTemplateFormatVersion",)))),
    Fingerprint("iac_kustomize", globs=("**/kustomization.yaml",)),
    Fingerprint("iac_docker_compose", globs=("**/docker-compose.yml", "**/compose.yaml", "**/compose.yml")),
    Fingerprint("iac_k8s_operator", globs=("**/kubebuilder.yaml",), hints=(("**/*.go", ("Reconcile(", "controllerutil.")),)),
    # data and training
    Fingerprint("data_pipeline_airflow", globs=("**/airflow.cfg",), hints=(("**/*.py", ("from airflow", "DAG(", "@dag", "@task")),)),
    Fingerprint("data_pipeline_dbt", globs=("**/dbt_project.yml",), hint_globs=("**/models/**",)),
    Fingerprint("data_pipeline_prefect", globs=("**/prefect.yaml",), hints=(("**/*.py", ("@flow", "@task", "from prefect")),)),
    Fingerprint("data_pipeline_dagster", globs=("**/dagster.yaml",), hints=(("**/*.py", ("@asset", "@op", "from dagster")),)),
    Fingerprint(
        "ml_training",
        holds=(
            ("**/pyproject.toml", ("torch", "tensorflow", "jax", "transformers", "scikit-learn", "lightning")),
            ("**/requirements.txt", ("torch", "tensorflow", "jax", "transformers", "scikit-learn", "lightning")),
        ),
        hints=(("**/*.py", ("nn.Module", "train_step", "optimizer.step", "loss.backward")),),
        unless=("web_service_python", "library_python"),
    ),
    # systems
    Fingerprint(
        "crypto_library",
        holds=(("**/Cargo.toml", ("aes", "rsa", "ed25519", "hkdf", "x25519")), ("**/go.mod", ("crypto/aes", "crypto/rsa", "crypto/ed25519"))),
        hints=(("**/*.rs", ("constant_time", "subtle::")), ("**/*.go", ("subtle.ConstantTimeCompare",))),
    ),
    Fingerprint("network_protocol_impl", holds=(("**/*.c", ("parse_packet", "encode_packet", "packet_header")), ("**/*.rs", ("parse_packet", "PacketHeader")), ("**/*.go", ("parsePacket", "PacketHeader")))),
    Fingerprint("database_engine", holds=(("**/*.c", ("wal_append", "page_alloc", "commit_record", "btree_split")), ("**/*.rs", ("wal_append", "page_alloc", "commit_record", "btree_split")))),
    Fingerprint("distributed_system", holds=(("**/*.go", ("appendEntries", "requestVote", "proposeValue")), ("**/*.rs", ("appendEntries", "request_vote", "propose_value")), ("**/*.java", ("appendEntries", "requestVote")))),
    # desktop
    Fingerprint("desktop_qt", holds=(("**/CMakeLists.txt", ("find_package(Qt6", "find_package(Qt5")), ("**/*.pro", ("QT +=",))), hints=(("**/*.cpp", ("QApplication", "QMainWindow")),)),
    Fingerprint("desktop_gtk", holds=(("**/Cargo.toml", ("gtk4", "gtk3")), ("**/CMakeLists.txt", ("gtk4", "gtk-3.0"))), hints=(("**/*.c", ("gtk_init", "gtk_application_new")), ("**/*.rs", ("gtk::Application::new",)))),
    Fingerprint("desktop_electron", holds=(("**/package.json", ('"electron":',)),), hints=(("**/*.js", ("BrowserWindow", "app.on('ready'")), ("**/*.ts", ("BrowserWindow", "app.on('ready'")))),
    Fingerprint("desktop_tauri", globs=("**/tauri.conf.json", "**/src-tauri/**"), hints=(("**/*.rs", ("#[tauri::command]",)),)),
    Fingerprint("webgl_three", holds=(("**/package.json", ('"three":', '"@react-three/fiber":')),), hints=(("**/*.ts", ("WebGLRenderer", "Scene(")), ("**/*.js", ("WebGLRenderer", "new Scene(")))),
    # servers of messages
    Fingerprint(
        "websocket_server",
        holds=(("**/package.json", ('"ws":', '"socket.io":')), ("**/Cargo.toml", ("tokio-tungstenite",)), ("**/go.mod", ("github.com/gorilla/websocket",))),
        hints=(("**/*.js", ("onmessage", "WebSocket(")), ("**/*.ts", ("onmessage", "WebSocket("))),
    ),
    Fingerprint(
        "message_queue_consumer",
        holds=(
            ("**/pyproject.toml", ("kafka-python", "confluent-kafka", "pika", "redis", "boto3", "nats-py")),
            ("**/package.json", ('"kafkajs":', '"amqplib":', '"redis":', '"@aws-sdk/client-sqs":', '"nats":')),
            ("**/go.mod", ("github.com/segmentio/kafka-go", "github.com/streadway/amqp", "github.com/nats-io/nats.go")),
        ),
        hints=(("**/*.py", ("consume(", "subscribe(", "channel.basic_consume")), ("**/*.js", ("consume(", "subscribe(", "ack()"))),
    ),
)


def checks_of(fingerprints: Sequence[Fingerprint]) -> list[tuple]:
    """Every (glob, texts) that any fingerprint asks for, once; texts are empty where the name is enough."""
    asked = {(g, ()) for f in fingerprints for g in (*f.globs, *f.hint_globs)} | {c for f in fingerprints for c in (*f.holds, *f.hints)}
    return sorted(asked)


def met_checks(files: DataFrame, fingerprints: Sequence[Fingerprint], by: Sequence[str] = ()) -> DataFrame:
    """check (its number), n and first, of each set of files: how many meet a check and the first path of these, by folders."""
    met = matches(files, checks_of(fingerprints), by=by, most=PREVIEW)
    parts = F.split("path", "/")
    return met.groupBy(*by, "check").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.min(parts), "/").alias("first"))


def decided(met: dict[int, str], fingerprints: Sequence[Fingerprint], number: dict[tuple, int]) -> list[tuple]:
    """(type, confidence, evidence) of a set of files, given the first path of each check that it meets."""
    has, held, out = lambda c: number[c] in met, set(), []
    for f in fingerprints:
        asked = [(g, ()) for g in f.globs]
        if not (asked or f.holds) or held.intersection(f.unless) or not all(map(has, f.holds)) or asked and not any(map(has, asked)):
            continue
        held.add(f.name)
        hints = [(g, ()) for g in f.hint_globs] + list(f.hints)
        out.append((f.name, sum(map(has, hints)), [f"{c[0]}: {met[number[c]]}" for c in asked + list(f.holds) + hints if has(c)]))
    return out or [("unknown_software", 0, [])]


def detected_types(files: DataFrame, fingerprints: Sequence[Fingerprint] = FINGERPRINTS, by: Sequence[str] = ()) -> DataFrame:
    """type, confidence, evidence (glob: first path, of all checks met); ``unknown_software`` if nothing holds. ``by``: columns of a set of
    files, such as a repository's name; every set of which there is a file gets its types."""
    number = {c: k for k, c in enumerate(checks_of(fingerprints))}
    met = met_checks(files, fingerprints, by).select(*by, F.struct("check", "first").alias("m"))
    if by:  # sets that meet nothing
        met = met.unionByName(files.select(*by).distinct(), allowMissingColumns=True)
    rows = met.groupBy(*by).agg(F.array_compact(F.collect_list("m")).alias("met"))  # no longer than the checks
    each = StructType([StructField("type", StringType()), StructField("hits", IntegerType()), StructField("evidence", ArrayType(StringType()))])
    schema = StructType([*rows.select(*by).schema.fields, StructField("types", ArrayType(each))])

    def run(batches):
        for batch in batches:
            found = [decided({m["check"]: m["first"] for m in some}, fingerprints, number) for some in batch.column("met").to_pylist()]
            values = pa.array([[dict(zip(("type", "hits", "evidence"), t)) for t in some] for some in found], pa.list_(pa.struct([("type", pa.string()), ("hits", pa.int32()), ("evidence", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), values], [*by, "types"])

    return rows.mapInArrow(run, schema).select(*by, F.explode("types").alias("t")).select(*by, "t.type", confidence(F.col("t.hits")).alias("confidence"), "t.evidence")
