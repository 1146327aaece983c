"""Dictionary tagging: a tag applies if any of its keywords occurs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component keywords looked for in code.
CODE_TAGS = {
    "TRM__Snapdragon_212": ("snapdragon", "apq8009", "qualcomm", "yocto", "cozmongine"),
    "TRM__STM32_Body_Board": ("stm32", "body_board", "bodyboard", "spi", "pid", "encoder", "cliff",
                              "gpio", "pwm", "backpack"),
    "TRM__QCA9377_WiFi_BLE": ("qca9377", "wifi", "bluetooth", "ble", "wlan", "onboard"),
    "TRM__Camera_OV7740": ("ov7740", "camera", "vision", "capture", "face_image", "vga", "cmos"),
    "TRM__Mic_Array": ("microphone", "mic_array", "beamform", "wake_word", "audio_stream"),
    "TRM__Laser_ToF_VL53L0X": ("vl53l0x", "tof", "laser_range", "lidar", "obstacle_detect", "cliff_sensor"),
    "TRM__Motors_Wheels_Head_Lift": ("motor_ctrl", "wheel_speed", "drive_straight", "head_motor",
                                     "lift_motor", "encoder_count", "pwm_duty", "pid_loop"),
    "TRM__Face_Display_IPS": ("set_eye_color", "eye_color", "face_display", "lcd_draw", "ips_",
                              "eye_render", "animate_face"),
}
# Component keywords looked for in manual tables.
TABLE_TAGS = {
    "TRM__Snapdragon_212": ("snapdragon", "apq8009", "qualcomm", "linux", "yocto", "cozmongine"),
    "TRM__STM32_Body_Board": ("stm32", "f427", "body board", "body-board", "spi", "pid", "encoder", "motor",
                              "cliff", "ik", "inverse kinematics", "gpio", "pa0", "pa1", "pwm"),
    "TRM__QCA9377_WiFi_BLE": ("qca9377", "wifi", "bluetooth", "ble", "wlan", "network", "gateway", "onboarding"),
    "TRM__Camera_OV7740": ("ov7740", "camera", "vision", "image", "capture", "face", "opencv", "vga", "cmos"),
    "TRM__Mic_Array": ("microphone", "mic", "beamforming", "wake word", "sensory", "vtt", "audio", "speech"),
    "TRM__Laser_ToF_VL53L0X": ("vl53l0x", "tof", "laser", "lidar", "ranging", "distance", "obstacle", "cliff",
                               "time of flight", "prox"),
    "TRM__Motors_Wheels_Head_Lift": ("motor", "wheel", "drive", "locomotion", "head", "lift", "encoder", "pwm",
                                     "pid", "dc motor", "tracks", "h-bridge"),
    "TRM__Face_Display_IPS": ("display", "lcd", "ips", "tft", "eye", "face", "render", "animation", "screen"),
}
# Component keywords looked for in manual notes.
NOTE_TAGS = {
    "TRM__Snapdragon_212": ("snapdragon", "apq8009", "qualcomm", "linux", "yocto"),
    "TRM__STM32_Body_Board": ("stm32", "body board", "body-board", "spi", "pid", "encoder", "motor", "cliff", "gpio"),
    "TRM__QCA9377_WiFi_BLE": ("qca9377", "wifi", "bluetooth", "ble", "wlan", "network"),
    "TRM__Camera_OV7740": ("ov7740", "camera", "vision", "image", "capture", "face"),
    "TRM__Mic_Array": ("microphone", "mic", "beamforming", "wake word", "audio", "speech"),
    "TRM__Laser_ToF_VL53L0X": ("vl53l0x", "tof", "laser", "lidar", "ranging", "distance", "obstacle", "cliff"),
    "TRM__Motors_Wheels_Head_Lift": ("motor", "wheel", "drive", "locomotion", "head", "lift", "encoder", "pwm",
                                     "pid", "h-bridge", "integrat"),
    "TRM__Face_Display_IPS": ("display", "lcd", "ips", "tft", "eye", "face", "render", "animation"),
}


def tags_of(text: Column, tags=CODE_TAGS) -> Column:
    """Tags, in dictionary order, with a keyword that occurs in the text."""
    def of(low: Column) -> Column:
        hits = []
        for tag, keywords in tags.items():
            found = F.lit(False)
            for keyword in keywords:
                found = found | low.contains(keyword)
            hits.append(F.when(found, F.lit(tag)))
        return F.filter(F.array(*hits), lambda t: t.isNotNull())

    # A lambda's argument is computed once; else the text is put in lower case for every keyword.
    return F.transform(F.array(F.lower(text)), of)[0]


def tags_sql(column: str, tags=CODE_TAGS) -> str:
    """The same rule as SQL text, joined by ``|``."""
    parts = []
    for tag, keywords in tags.items():
        test = " OR ".join(f"contains(lower({column}), '{k}')" for k in keywords)
        parts.append(f"CASE WHEN {test} THEN '{tag}' END")
    return "concat_ws('|', " + ", ".join(parts) + ")"
